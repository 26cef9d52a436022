"""Building the inverted index: documents to docs, lengths and postings tables.

    docs      doc_key, the stored fields
    vectors   doc_key, field, n_tokens, terms, tfs  a row for each field a document has
    lengths   doc_key, field, n_tokens              the same without terms
    postings  field, term, doc_key, tf, len_code

On disk these are two packed tables, whose rows the JVM moves as a few strings each:

    packed    doc_key, field, n_tokens, terms, sizes, tfs  vectors, a row's terms and numbers as bytes
    blocks    field, term, n, keys, odd_keys, counts       n postings of a term, in runs sorted by term and field

A document's terms are counted where it is analysed and sorted where they are written, so
no shuffle groups or sorts them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrid.functions import terms
from glyphgrid.functions.analysis import LOWERCASE, STANDARD, Analyzer, Tokens, list_tokens, split_list
from glyphgrid.functions.similarity import length_code
from glyphgrid.functions.words import split_all
from glyphgrid.plans.mapping import ALL, Field, Mapping, Settings

TOKENS = "array<struct<term:binary,position:int>>"


class FieldValueError(ValueError):
    """A document that its mapping doesn't admit."""


def _as_terms(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(t["term"].cast("binary").alias("term"), t["position"].cast("int").alias("position")))


def _one(term: Column) -> Column:
    return F.array(F.struct(term.alias("term"), F.lit(1).alias("position")))


def _text_tokens(value: Column, analyzer: Analyzer | None) -> Column:
    return _one(terms.text_term(value)) if analyzer is None else _as_terms(analyzer.tokens(value))


def value_tokens(name: str, f: Field, kind: T.DataType, settings: Settings) -> Column:
    """What a column is indexed as; null where it is null, which is a missing field."""
    value, analyzer = F.col(f"`{name}`"), f.use(settings, "index")
    if f.type == "string":
        if isinstance(kind, T.ArrayType):
            out = _as_terms(list_tokens(value.cast("array<string>"), analyzer))
        else:
            out = _text_tokens(value.cast("string"), analyzer)
    else:
        out = _one(exact_term(name, f, kind))
    return F.when(value.isNotNull(), out)


def exact_term(name: str, f: Field, kind: T.DataType) -> Column:
    """The one term of a value that isn't analysed."""
    value = F.col(f"`{name}`")
    if f.type == "string":
        return terms.text_term(value.cast("string"))
    if f.type == "integer":
        return terms.integer_term(value)
    if f.type == "boolean":
        flag = value if isinstance(kind, T.BooleanType) else value.cast("string").isin("yes") if isinstance(kind, T.StringType) else F.lit(False)
        return terms.boolean_term(flag)
    return terms.instant_term(value)


def stored_value(name: str, f: Field, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if f.type == "string" and isinstance(kind, T.ArrayType):
        return F.array_join(value.cast("array<string>"), " ")
    if f.type == "boolean" and not isinstance(kind, T.BooleanType):
        flag = value.cast("string") == "yes" if isinstance(kind, T.StringType) else F.lit(False)
        return F.when(value.isNotNull(), flag)
    return value.cast({"string": "string", "integer": "bigint", "boolean": "boolean", "date": "timestamp"}[f.type])


_ADMITTED = {"integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "date": (T.TimestampType, T.TimestampNTZType)}


def check(docs: DataFrame, mapping: Mapping, key: str) -> None:
    """Raises FieldValueError for columns that aren't mapped or don't have a type that is admitted."""
    for f in docs.schema:
        if f.name in (key, ALL) or f.name in mapping.nested:
            continue
        if f.name not in mapping.fields:
            raise FieldValueError(f"FieldDoesntExist: {f.name}")
        want = mapping.fields[f.name].type
        if want in _ADMITTED and not isinstance(f.dataType, _ADMITTED[want]):
            raise FieldValueError(f"FieldValueError: {f.name} is {f.dataType.simpleString()}, not {want}")
        if want == "string" and isinstance(f.dataType, (T.StructType, T.MapType, T.BinaryType)):
            raise FieldValueError(f"FieldValueError: {f.name} is {f.dataType.simpleString()}, not {want}")


@dataclass(frozen=True)
class Index:
    """The tables of an index as DataFrames, with what is derived from them."""

    docs: DataFrame
    lengths: DataFrame
    postings: DataFrame
    mapping: Mapping
    settings: Settings = field(default_factory=Settings)
    vectors: DataFrame | None = None
    packed: DataFrame | None = None

    @cached_property
    def field_stats(self) -> DataFrame:
        """(field, n_docs, n_tokens); a document has a field even where it has no token."""
        return self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    @cached_property
    def term_stats(self) -> DataFrame:
        """(field, term, df)."""
        return self.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    @property
    def searchable(self) -> dict[str, Analyzer | None]:
        return self.mapping.searchable(self.settings)


def analyse(docs: DataFrame, mapping: Mapping, key: str, settings: Settings | None = None) -> DataFrame:
    """(doc_key, field, tokens): a row for each indexed field that a document has, _all among them.

    Unless the mapping has a field _all, it is the column _all where docs have
    one, else all indexed text columns that are in it, in order of their names.
    """
    settings = settings or Settings()
    check(docs, mapping, key)
    kinds = {f.name: f.dataType for f in docs.schema}
    name = lambda n: F.lit(n).alias("field")
    fields = [(n, value_tokens(n, f, kinds[n], settings)) for n, f in sorted(mapping.fields.items()) if f.indexed and n in kinds]
    if ALL not in mapping.fields:
        texts = [F.col(ALL)] if ALL in kinds else [F.col(f"`{n}`") for n, f in sorted(mapping.fields.items()) if f.indexed and f.in_all and isinstance(kinds.get(n), T.StringType)]
        fields.append((ALL, _as_terms(STANDARD.tokens(F.concat_ws(" ", *texts)))))
    rows = F.array(*[F.struct(name(n), tokens.cast(TOKENS).alias("tokens")) for n, tokens in fields])
    return docs.select(F.col(f"`{key}`").cast("string").alias("doc_key"), F.explode(rows).alias("r")).select("doc_key", "r.field", "r.tokens").where("tokens IS NOT NULL")


VECTORS = "doc_key string, field string, n_tokens bigint, terms array<binary>, tfs array<int>"
PACKED = "doc_key string, field string, n_tokens bigint, terms binary, sizes binary, tfs binary"
_ROWS = 1000
_OUT = 100_000


def count_tokens(tokens: Tokens) -> tuple[int, list[str], list[int]]:
    """(length, terms, their frequencies); a frequency counts distinct positions."""
    found, at = tokens
    if at is None:
        count = Counter(found)
        return len(found), list(count), list(count.values())
    count = Counter(t for t, _ in dict.fromkeys(zip(found, at)))
    return sum(count.values()), list(count), list(count.values())


def vectors(docs: DataFrame, mapping: Mapping, key: str, settings: Settings | None = None, pack: bool = False) -> DataFrame:
    """(doc_key, field, n_tokens, terms, tfs): analyse() with its tokens counted, in one pass over the documents; with pack as packed rows.

    What _all has of fields that the standard analyzer analyses is taken from these.
    """
    settings = settings or Settings()
    check(docs, mapping, key)
    kinds = {f.name: f.dataType for f in docs.schema}
    columns: list[Column] = [F.col(f"`{key}`").cast("string").alias("k")]
    plan: list[tuple[str, str, Analyzer | None]] = []
    place: dict[str, int] = {}
    for n, f in sorted(mapping.fields.items()):
        if not f.indexed or n not in kinds:
            continue
        analyzer = f.use(settings, "index")
        if f.type == "string" and isinstance(kinds[n], T.ArrayType):
            plan.append((n, "list", analyzer))
            columns.append(F.col(f"`{n}`").cast("array<string>"))
        elif f.type == "string" and analyzer is not None:
            plan.append((n, "text", analyzer))
            columns.append(F.col(f"`{n}`").cast("string"))
            place[n] = len(plan)
        else:
            plan.append((n, "term", None))
            columns.append(F.when(F.col(f"`{n}`").isNotNull(), exact_term(n, f, kinds[n])))
    parts: list[int] = []
    if ALL not in mapping.fields:
        own = [ALL] if ALL in kinds else [n for n, f in sorted(mapping.fields.items()) if f.indexed and f.in_all and isinstance(kinds.get(n), T.StringType)]
        for n in own:
            if n not in place:
                place[n] = len(columns)
                columns.append(F.col(f"`{n}`"))
            parts.append(place[n])
    every = ALL not in mapping.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for b in counted(batch.slice(at, _ROWS)):
                    yield _packed(b) if pack else b

    def counted(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = [b.column(i).to_pylist() for i in range(b.num_columns)]
        keys = b.column(0)
        seen: dict[int, Words] = {}
        for i, (name, how, analyzer) in enumerate(plan, 1):
            if how == "term":
                at = np.flatnonzero(np.array([v is not None for v in values[i]]))
                one = np.ones(len(at), np.int64)
                yield _vectors(keys.take(pa.array(at)), name, one, np.arange(len(at) + 1), b.column(i).take(pa.array(at)), one)
            elif how == "text" and analyzer.one_per_position:
                found = Words.of(values[i], analyzer)
                if analyzer == STANDARD:
                    seen[i] = found
                yield _vectors(keys.take(pa.array(found.rows)), name, *found.counted())
            else:
                yield _slowly(keys, name, [None if v is None else split_list(v, analyzer) if how == "list" else analyzer.split(v) for v in values[i]])
        if every:
            texts = [[values[i][row] for i in parts if values[i][row] is not None] for row in range(b.num_rows)]
            # a mark that a text begins with would go with the blank before it
            joined = [" ".join(t) if any(x and not x[0].isalnum() and not x[0].isascii() for x in t[1:]) else None for t in texts]
            apart = np.array([t is None for t in joined])
            all_ = [seen[i] if i in seen else Words.of(values[i], STANDARD) for i in parts]
            found = Words.joined(b.num_rows, [w.only(apart) for w in all_] + [Words.of(joined, STANDARD)])
            yield _vectors(keys, ALL, *found.counted())

    # tasks of one size, more of them for more documents
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).hint("rebalance").mapInArrow(run, PACKED if pack else VECTORS)


@dataclass(frozen=True)
class Words:
    """Words of some rows, one by one: rows has those that have the field, row and word (a place in terms) each word's own."""

    rows: np.ndarray
    row: np.ndarray
    word: np.ndarray
    terms: pa.Array

    @classmethod
    def of(cls, texts: list[str | None], analyzer: Analyzer) -> Words:
        """Filters change each distinct word of all rows once."""
        rows = np.array([i for i, t in enumerate(texts) if t is not None], np.int64)
        row, found = split_all([t for t in texts if t is not None])
        encoded = found.dictionary_encode()
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(encoded.dictionary)], pa.int32()), encoded.dictionary), "\n")[0].as_py()
        for f in (LOWERCASE,) * (analyzer.tokenizer.kind == "lowercase") + analyzer.filters:
            lines = f.of_lines(lines)
        changed = _of_lines(lines, len(encoded.dictionary)).dictionary_encode()
        word = changed.indices.to_numpy()[encoded.indices.to_numpy()] if len(found) else np.zeros(0, np.int32)
        return cls(rows, rows[row], word.astype(np.int64), changed.dictionary)

    @classmethod
    def joined(cls, n: int, parts: list[Words]) -> Words:
        """The words of all parts in each of n rows."""
        terms = pa.chunked_array([p.terms for p in parts], pa.string()).combine_chunks().dictionary_encode()
        place, starts = terms.indices.to_numpy(), np.cumsum([0, *[len(p.terms) for p in parts]])
        word = np.concatenate([place[p.word + at] for p, at in zip(parts, starts)])
        return cls(np.arange(n), np.concatenate([p.row for p in parts]), word.astype(np.int64), terms.dictionary)

    def only(self, which: np.ndarray) -> Words:
        """Without the words of rows that which doesn't have."""
        if which.all():
            return self
        kept = which[self.row]
        return Words(self.rows, self.row[kept], self.word[kept], self.terms)

    def counted(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(lengths, offsets, terms, their frequencies) of rows, each row's distinct words together."""
        width = max(len(self.terms), 1)
        key, tf = np.unique(self.row * width + self.word, return_counts=True)
        lengths = np.bincount(self.row, minlength=int(self.rows[-1]) + 1 if len(self.rows) else 0)[self.rows]
        return lengths, np.append(np.searchsorted(key, self.rows * width), len(key)), self.terms.take(pa.array(key % width)).cast(pa.binary()), tf


def _strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def _of_lines(lines: str, n: int) -> pa.Array:
    """n strings that are a line each."""
    data = np.frombuffer(lines.encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))[:n]
    offsets = np.append(0, ends - np.arange(n)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])


def _vectors(keys: pa.Array, name: str, lengths: np.ndarray, offsets: np.ndarray, terms_: pa.Array, tfs: np.ndarray) -> pa.RecordBatch:
    at = pa.array(offsets.astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, x) for x in (terms_.cast(pa.binary()), pa.array(tfs.astype(np.int32)))]
    return pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(lengths.astype(np.int64)), *lists], names=["doc_key", "field", "n_tokens", "terms", "tfs"])


def _slowly(keys: pa.Array, name: str, each: list[Tokens | None]) -> pa.RecordBatch:
    """The same where a row's tokens share positions, or are of a list."""
    at = [i for i, x in enumerate(each) if x is not None]
    lengths, offsets, found, tfs = [], [0], [], []
    for i in at:
        n, t, c = count_tokens(each[i])
        lengths.append(n)
        found += t
        tfs += c
        offsets.append(len(found))
    return _vectors(keys.take(pa.array(at, pa.int64())), name, np.array(lengths, np.int64), np.array(offsets), _strings(found), np.array(tfs, np.int64))


def _offsets(x: pa.Array) -> np.ndarray:
    """Where the values of a binary array begin and end in its bytes."""
    return np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int32)


def _bytes(offsets: np.ndarray, data: pa.Buffer | np.ndarray | None) -> pa.Array:
    data = data if isinstance(data, pa.Buffer) else pa.py_buffer(b"" if data is None else np.ascontiguousarray(data))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data])


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors with a row's terms one after another, their sizes and frequencies as 4 bytes each; no term is copied."""
    lists, tfs = b.column("terms"), b.column("tfs")
    values, at = lists.values, lists.offsets.to_numpy()
    ends = _offsets(values)
    made = {"terms": _bytes(ends[at], values.buffers()[2]), "sizes": _bytes(at * 4, np.diff(ends)), "tfs": _bytes(tfs.offsets.to_numpy() * 4, tfs.values.to_numpy())}
    rest = [c for c in b.schema.names if c not in made]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *made.values()], names=[*rest, *made])


def _numbers(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of rows of 4 bytes a number."""
    ends, data = _offsets(x), x.buffers()[2]
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return (ends - ends[0]) // 4, np.ascontiguousarray(own).view(np.int32)


def _lists(b: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors from packed ones."""
    if "sizes" not in b.schema.names:
        return b
    terms_, sizes, tfs = (b.column(c).cast(pa.binary()) for c in ("terms", "sizes", "tfs"))
    at, size = _numbers(sizes)
    values = _bytes(_offsets(terms_)[0] + np.append(0, np.cumsum(size)), terms_.buffers()[2])
    made = {"terms": pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), "tfs": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_numbers(tfs)[1]))}
    rest = [c for c in b.schema.names if c not in ("terms", "sizes", "tfs")]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *made.values()], names=[*rest, *made])


def _changed(found: DataFrame, change: str, into: str) -> DataFrame:
    """found with vectors in another form and its further columns."""
    of = {"lists": _lists, "packed": _packed}[change]
    more = [f for f in found.schema if f.name not in ("doc_key", "field", "n_tokens", "terms", "sizes", "tfs")]
    names = [*[c.split()[0] for c in into.split(", ")], *[f.name for f in more]]
    schema = ", ".join([into, *[f"`{f.name}` {f.dataType.simpleString()}" for f in more]])
    return found.mapInArrow(lambda batches: (of(b).select(names) for b in batches), schema)


def pack(found: DataFrame) -> DataFrame:
    return _changed(found, "packed", PACKED)


def unpack(found: DataFrame) -> DataFrame:
    return _changed(found, "lists", VECTORS)


def lengths_of(found: DataFrame) -> DataFrame:
    """(doc_key, field, n_tokens) of vectors, packed or not, and their other columns."""
    return found.drop("terms", "sizes", "tfs")


def postings_of(found: DataFrame) -> DataFrame:
    """(field, term, doc_key, tf, len_code) of vectors, and their other columns."""
    more = [c for c in found.columns if c not in ("doc_key", "field", "n_tokens", "terms", "tfs")]
    spread = found.select("doc_key", "field", "n_tokens", *more, F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return spread.select("field", F.col("t.terms").alias("term"), "doc_key", F.col("t.tfs").alias("tf"), length_code(F.col("n_tokens")).alias("len_code"), *more)


#: Postings that are sorted at once; a run of sorted postings has as many, unless one document's row has more.
RUN = 2_000_000


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, terms, tf) of the postings of vectors."""
    lists = b.column("terms")
    return np.repeat(np.arange(b.num_rows, dtype=np.int32), lists.value_lengths().to_numpy()), lists.flatten(), b.column("tfs").flatten().to_numpy()


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of each value in order, the distinct values in order)."""
    encoded = values.dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return place[encoded.indices.to_numpy()], encoded.dictionary.take(order)


def _pieces(batches: Iterator[pa.RecordBatch], most: int = RUN) -> Iterator[pa.RecordBatch]:
    """Rows of vectors, so many that they have about most postings."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        ends = np.cumsum(b.column("terms").value_lengths().to_numpy()) if b.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + most - n, "right")), at + (not held))
            if to > at:
                held.append(b.slice(at, to - at))
                n += int(ends[to - 1]) - before
                at = to
            if at < b.num_rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


#: Postings in a row of blocks at most; a term that has more has several rows.
BLOCK = 10_000
#: What parts the keys of a block, unless one of these has it.
_PART = "\x1f"
BLOCKS = "field string, term binary, n int, keys string, odd_keys array<string>, counts string"


def _in_order(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group sorted, where each was); those of one group stay in order."""
    shift = max(len(group) - 1, 1).bit_length()
    if len(group) and int(group.max()).bit_length() + shift > 62:
        order = np.argsort(group, kind="stable")
        return group[order], order.astype(np.int32)
    # numbers that end in their place are sorted several times faster than places are
    both = group.astype(np.int64)
    both <<= shift
    both |= np.arange(len(group))
    both.sort()
    return (both >> shift).astype(group.dtype), (both & ((1 << shift) - 1)).astype(np.int32)


def _starts(group: np.ndarray, most: int) -> np.ndarray:
    """Where blocks of sorted postings begin, and their end: at each new group, and after so many of one."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(group)))
    long = np.flatnonzero(sizes > most)
    more = [np.arange(first[i] + most, first[i] + sizes[i], most) for i in long]
    return np.append(np.sort(np.concatenate([first, *more])), len(group))


def _blocks(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one run; what has a number for each posting has 4 bytes and goes when it has been used."""
    row, values, tf = _flat(b)
    name, names = _ranked(b.column("field"))
    term, distinct = _ranked(values)
    del values
    keys = b.column("doc_key")
    odd = keys.null_count > 0 or bool(pc.any(pc.match_substring(keys, _PART)).as_py())
    code = np.clip(np.floor((np.sqrt(b.column("n_tokens").to_numpy().astype(np.float64)) - 1) * 3), 0, 255).astype(np.int64)
    group = term if len(distinct) * len(names) < 2**31 else term.astype(np.int64)
    group = group * group.dtype.type(max(len(names), 1)) + name[row]
    group, order = _in_order(group)
    starts = _starts(group, most)
    del group
    at = 0
    while at < len(starts) - 1:
        to = max(int(np.searchsorted(starts, starts[at] + _OUT, "right")) - 1, at + 1)
        o, one = order[starts[at] : starts[to]], order[starts[at:to]]
        ends = pa.array(starts[at : to + 1] - starts[at], pa.int32())
        spread = pa.ListArray.from_arrays(ends, keys.take(pa.array(row[o])))
        counts = pa.ListArray.from_arrays(ends, pa.array(tf[o] * np.int64(256) + code[row[o]]).cast(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(name[row[one]])),
                distinct.take(pa.array(term[one])),
                pa.array(np.diff(starts[at : to + 1]), pa.int32()),
                pa.nulls(to - at, pa.string()) if odd else pc.binary_join(spread, _PART),
                spread if odd else pa.nulls(to - at, pa.list_(pa.string())),
                pc.binary_join(counts, ","),
            ],
            names=["field", "term", "n", "keys", "odd_keys", "counts"],
        )
        at = to


def posting_blocks(found: DataFrame) -> DataFrame:
    """postings_of() as blocks, in runs that are sorted by term and field, without a shuffle: written as they come, a term's rows lie in few pages of each run.

    keys are those of the block's postings, odd_keys the same where they can't be
    joined; counts has 256 tf + len_code of each.  found, packed or not, comes from
    files, in whatever parts these are read.
    """
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(map(_lists, batches)):
            yield from _blocks(b, most)

    return found.select(*[c for c in ("doc_key", "field", "n_tokens", "terms", "sizes", "tfs") if c in found.columns]).mapInArrow(run, BLOCKS)


def spread_blocks(blocks: DataFrame) -> DataFrame:
    """(field, term, doc_key, tf, len_code) of blocks, and their other columns; filters on field and term reach the scan."""
    more = [c for c in blocks.columns if c not in ("field", "term", "n", "keys", "odd_keys", "counts")]
    each = F.arrays_zip(F.coalesce("odd_keys", F.split("keys", _PART)).alias("k"), F.split("counts", ",").alias("c"))
    rows = blocks.select("field", "term", *more, F.explode(each).alias("t"))
    count = F.col("t.c").cast("bigint")
    return rows.select("field", "term", F.col("t.k").alias("doc_key"), F.shiftright(count, 8).cast("int").alias("tf"), count.bitwiseAND(255).cast("int").alias("len_code"), *more)


def sorted_postings(found: DataFrame) -> DataFrame:
    """postings_of() in the order of posting_blocks()."""
    return spread_blocks(posting_blocks(found))


def blocks_df(blocks: DataFrame) -> DataFrame:
    """(field, term, df) of blocks, which tell how many postings they have."""
    return blocks.groupBy("field", "term").agg(F.sum("n").alias("df"))


def term_counts(found: DataFrame) -> DataFrame:
    """(segment, field, term, df) of packed vectors of segments; postings are counted where they are read, so a term is shuffled once a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(map(_lists, batches)):
            row, values, _ = _flat(b)
            (segment, segments), (name, names) = _ranked(b.column("segment")), _ranked(b.column("field"))
            place = (segment * len(names) + name)[row]
            t = pa.table({"place": place, "term": values}).group_by(["place", "term"]).aggregate([([], "count_all")]).combine_chunks()
            for c in t.to_batches(_OUT):
                at = c.column("place").to_numpy()
                yield pa.RecordBatch.from_arrays([segments.take(pa.array(at // len(names))), names.take(pa.array(at % len(names))), c.column("term"), c.column("count_all")], names=["segment", "field", "term", "df"])

    spread = found.select("segment", "field", "terms", "sizes", "tfs").mapInArrow(run, "segment string, field string, term binary, df bigint")
    return spread.groupBy("segment", "field", "term").agg(F.sum("df").alias("df"))


def stored_columns(docs: DataFrame, mapping: Mapping, key: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in docs.schema}
    stored = [stored_value(n, f, kinds[n]).alias(n) for n, f in mapping.fields.items() if f.stored and n in kinds]
    kept = [F.col(f"`{n}`") for n in mapping.nested if n in kinds]
    return docs.select(F.col(f"`{key}`").cast("string").alias("doc_key"), *stored, *kept)


def build(docs: DataFrame, mapping: Mapping, key: str, settings: Settings | None = None) -> Index:
    """The index of docs, whose column key is unique and tells documents apart.

    A null value is a missing field.  tf counts distinct positions, so a gram that
    a word has twice counts once.
    """
    settings = settings or Settings()
    found = vectors(docs, mapping, key, settings)
    return Index(stored_columns(docs, mapping, key), lengths_of(found), postings_of(found), mapping, settings, found, vectors(docs, mapping, key, settings, pack=True))
