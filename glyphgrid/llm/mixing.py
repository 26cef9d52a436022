"""Mixing sources to target weights over fixed-length token blocks.

Tokens are runs of characters other than ASCII white space.  Each source's
documents, in an order drawn by hash, are cut into blocks of so many tokens.
Every output shard draws its counts per source from a multinomial, as many hashed
draws as it has slots; a source's slots, numbered through all shards, pass through
keyed Feistel permutations of its block indices, a new one for each epoch, and are
joined to the blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphgrid.llm.common import cut, parts
from glyphgrid.llm.wordhash import _MIX1, _MIX2, SPACE, mix

BLOCK_TOKENS, SHARD_SLOTS, TEMPERATURE = 512, 1024, 0.7
#: A source is cut into streams of about so many tokens that are blocked in parallel; one block in 488 is short.
STREAM_TOKENS = 250_000
#: With more sources than this their list is joined, not broadcast.
MAX_BROADCAST_SOURCES = 100_000
#: Slots are numbered within groups of so many shards, and groups among each other.
SHARD_GROUP = 1024
_FINE = 20
_BLANK = SPACE.copy()
_BLANK[[0, 11]] = False
_PIECES = "array<struct<doc_id:bigint,lang:string,n_tokens:bigint,text:string>>"


def token_count(text: str = "text") -> Column:
    """Number of tokens as a Column; null and blank texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t\\n\\r\\f]+"), lambda x: x != "")), F.lit(0)).cast("bigint")


def token_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the tokens begin and end."""
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_BLANK[np.frombuffer(raw, np.uint8)]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def feistel(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of range(size) chosen by key, applied to index; all row by row.

    A balanced Feistel network over the least even number of bits that holds
    size; results beyond it are walked on until they fall inside.
    """
    n = np.asarray(size, np.uint64)
    half = np.array([max(1, (max(int(x) - 1, 1).bit_length() + 1) // 2) for x in n], np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    key = np.asarray(key).astype(np.int64).view(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            left, right = right, left ^ (mix(right ^ mix(k + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def draws(seed: int, shard: int, slots: int, share: np.ndarray) -> np.ndarray:
    """The source of each slot of a shard: hashed draws by share, so that their counts are a multinomial's."""
    key = mix(np.array([seed], np.uint64)) + np.uint64(shard)
    u = (mix(mix(key) + np.arange(slots, dtype=np.uint64)) >> np.uint64(11)) * 2.0**-53
    return np.minimum(np.searchsorted(np.cumsum(share), u, side="right"), np.flatnonzero(share)[-1])


def block_stream(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows sorted by src and stream: (src, block, source, n_tokens, pieces).

    Blocks are numbered from the stream's base; its last one may be short.
    """
    rows: list[tuple] = []
    key, number, filled, pieces = None, 0, 0, []
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("text", pa.string())]))]

    def end() -> None:
        nonlocal number, filled, pieces
        if pieces:
            rows.append((key[0], key[3] + number, key[2], filled, pieces))
            number, filled, pieces = number + 1, 0, []

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["src", "block", "source", "n_tokens", "pieces"])
        rows.clear()
        return got

    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("src", "stream", "source", "base"))))
        doc, lang, text = b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text")
        for i in range(b.num_rows):
            if keys[i] != key:
                end()
                key, number = keys[i], 0
            raw = text[i].as_py().encode("utf-8", "replace")
            starts, ends = token_spans(raw)
            at = 0
            while at < len(starts):
                take = min(size - filled, len(starts) - at)
                pieces.append({"doc_id": doc[i], "lang": lang[i], "n_tokens": take, "text": raw[starts[at] : ends[at + take - 1]].decode("utf-8", "replace")})
                at, filled = at + take, filled + take
                if filled == size:
                    end()
            if len(rows) >= 500:
                yield out()
    end()
    if rows:
        yield out()


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, stream_tokens: int = STREAM_TOKENS) -> tuple[DataFrame, DataFrame, list[str | None]]:
    """(blocks, streams, sources): (src, block, source, n_tokens, pieces), (src, stream, blocks, base) and the names that src counts.

    A source of many tokens is cut by hash of doc_id and text into streams that
    are blocked in parallel, so neither a hot source nor a hot doc_id takes longer
    than the others; only the last block of a stream can be short.  A null source
    is a source.
    """
    spark = docs.sparkSession
    named = F.concat(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")), F.lit("|"), F.col("text"))
    fine = F.conv(F.substring(F.md5(named), 1, _FINE // 4), 16, 10).cast("bigint")
    own = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", "text", fine.alias("fine"))
    counted = cut(own.select("source", "fine", token_count().alias("n")).groupBy("source", "fine").agg(F.sum("n").alias("n")).where("n > 0"))
    # one row for each source comes to the driver: its name and count, no data
    per = sorted(((r["source"], r["n"]) for r in counted.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    bits = [min(_FINE, max(0, math.ceil(math.log2(n / stream_tokens)))) for _, n in per]
    known = spark.createDataFrame([(i, s, b) for i, ((s, _), b) in enumerate(zip(per, bits))], "src int, s string, bits int")
    known = F.broadcast(known) if len(per) <= MAX_BROADCAST_SOURCES else known

    def placed(df: DataFrame) -> DataFrame:
        stream = F.floor(F.col("fine") / F.pow(F.lit(2.0), F.lit(_FINE) - F.col("bits"))).cast("bigint")
        return df.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("stream", stream).drop("s", "bits")

    streams = placed(counted).groupBy("src", "stream").agg(F.ceil(F.sum("n") / F.lit(block_tokens)).cast("bigint").alias("blocks"))
    # some 2**_FINE streams a source at most
    streams = cut(streams.withColumn("base", F.sum("blocks").over(Window.partitionBy("src").orderBy("stream")) - F.col("blocks")))
    columns = ["src", "stream", "source", "base", "doc_id", "lang", "text"]
    # streams grow with the corpus: they are hashed task by task, never broadcast, and the texts move once
    spread = placed(own).repartition("src", "stream").join(streams.select("src", "stream", "base").hint("shuffle_hash"), ["src", "stream"])
    ordered = spread.sortWithinPartitions("src", "stream", "fine", "doc_id", "text", "lang").select(columns)
    made = ordered.mapInArrow(lambda batches: block_stream(batches, block_tokens), f"src int, block bigint, source string, n_tokens bigint, pieces {_PIECES}")
    return made, streams, [s for s, _ in per]


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, total_blocks: int | None = None, epochs: float | None = None, seed: int = 17) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, pieces): the mixed corpus, a row for each slot.

    pieces are the parts of documents in the block, in order, as (doc_id, lang,
    n_tokens, text).  weights are target shares of slots by source (those of
    sources that aren't there are ignored); by default a source's share goes with
    its number of blocks to the power TEMPERATURE.  There are as many slots as
    blocks unless total_blocks says otherwise, or epochs: then as many as give every
    source with a share so many passes, with four deviations of its draw to spare.
    A source drawn more often than it has blocks starts a new epoch in a new order;
    one drawn less often leaves blocks out.  Null and blank texts have no tokens and don't appear; repeated
    rows appear repeatedly; an empty table gives no rows.  A null doc_id, lang or
    source is carried along.
    """
    spark = docs.sparkSession
    made, streams, names = blocks(docs, block_tokens)
    counts = {r["src"]: r["n"] for r in streams.groupBy("src").agg(F.sum("blocks").alias("n")).collect()}
    have = np.array([counts[i] for i in range(len(names))], np.int64)
    share = np.array([float(weights.get(s, 0)) if weights is not None else float(n) ** TEMPERATURE for s, n in zip(names, have)])
    share = share / max(share.sum(), 1e-300)
    total = int(have.sum()) if total_blocks is None else total_blocks
    if epochs is not None:
        want = have * epochs
        total = max((math.ceil((n + 4 * math.sqrt(n) + 8) / p) for n, p in zip(want, share) if p > 0), default=0)
    if not len(have) or share.sum() <= 0:
        total = 0
    keys = np.array([int(hashlib.md5(b"" if s is None else b"s" + s.encode("utf-8")).hexdigest()[:12], 16) for s in names], np.uint64)

    def drawn(shard: int) -> np.ndarray:
        return draws(seed, shard, min(shard_slots, total - shard * shard_slots), share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column("id").to_pylist():
                src, c = np.unique(drawn(shard), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), shard)), pa.array(src.astype(np.int32)), pa.array(c.astype(np.int64))], names=["shard", "src", "c"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, starts in zip(b.column("shard").to_pylist(), b.column("starts").to_pylist()):
                of = drawn(shard)
                order = np.argsort(of, kind="stable")
                src, c = np.unique(of, return_counts=True)
                start = {x["src"]: x["start"] for x in starts}
                at = np.empty(len(of), np.int64)
                at[order] = np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c) + np.repeat([start[x] for x in src.tolist()], c)
                epoch, n = at // have[of], have[of]
                key = mix(mix(keys[of] + np.uint64(seed)) + epoch.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), shard)), pa.array(np.arange(len(of))), pa.array(of.astype(np.int32)), pa.array(epoch), pa.array(feistel(at % n, n, key))], names=["shard", "slot", "src", "epoch", "block"])

    # a source's slots are numbered through all shards: within groups of shards, and the groups among each other
    shards = math.ceil(total / shard_slots)
    per_shard = cut(spark.range(0, shards, 1, max(1, min(shards, parts(spark)))).mapInArrow(count, "shard bigint, src int, c bigint").withColumn("part", F.floor(F.col("shard") / SHARD_GROUP)))
    before = lambda by, at: F.sum("c").over(Window.partitionBy(*by).orderBy(at)) - F.col("c")
    whole = per_shard.groupBy("src", "part").agg(F.sum("c").alias("c")).select("src", "part", before(["src"], "part").alias("base"))
    inner = per_shard.select("src", "part", "shard", before(["src", "part"], "shard").alias("start"))
    starts = inner.join(whole.hint("shuffle_hash"), ["src", "part"]).select("shard", "src", (F.col("base") + F.col("start")).alias("start"))
    slots = starts.groupBy("shard").agg(F.collect_list(F.struct("src", "start")).alias("starts")).mapInArrow(place, "shard bigint, slot bigint, src int, epoch bigint, block bigint")
    # slots grow with the corpus: without the hint they would seem small, and be broadcast
    return made.join(slots.hint("shuffle_hash"), ["src", "block"]).select("shard", "slot", "source", "epoch", "block", "n_tokens", "pieces")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus as documents: each piece of a block a row (doc_id, text, lang, source, n_chars)."""
    at = mix_sources(docs, **parameters).select("source", F.explode("pieces").alias("p"))
    kinds = dict(docs.dtypes)
    out = {"doc_id": F.col("p.doc_id"), "text": F.col("p.text"), "lang": F.col("p.lang"), "source": F.col("source"), "n_chars": F.length("p.text")}
    return at.select(*[out[c].cast(kinds.get(c, "bigint")).alias(c) for c in out])


def pieces(mixed: DataFrame) -> DataFrame:
    """mix_sources() with a row for each piece: (shard, slot, piece, source, epoch, block, doc_id, lang, n_tokens, text)."""
    at = mixed.select("shard", "slot", "source", "epoch", "block", F.posexplode("pieces").alias("piece", "p"))
    return at.select("shard", "slot", "piece", "source", "epoch", "block", "p.doc_id", "p.lang", "p.n_tokens", "p.text")


def sql(block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, stream_tokens: int = STREAM_TOKENS, seed: int = 17) -> str:
    """pieces() of mix_sources() without weights in DuckDB SQL over the view documents."""
    mask = "18446744073709551615::UHUGEINT"
    mul = lambda x, y: f"CAST((({x})::UHUGEINT * {y}::UHUGEINT) & {mask} AS UBIGINT)"
    add = lambda x, y: f"CAST((({x})::UHUGEINT + ({y})::UHUGEINT) & {mask} AS UBIGINT)"
    mixed = lambda x, n: f"{x} AS {n}0, xor({n}0, {n}0 >> 30) AS {n}1, {mul(f'{n}1', int(_MIX1))} AS {n}2, xor({n}2, {n}2 >> 27) AS {n}3, {mul(f'{n}3', int(_MIX2))} AS {n}4, xor({n}4, {n}4 >> 31) AS {n}"
    start = int(mix(np.array([seed], np.uint64))[0])
    blank = "[ \\t\\n\\r\\f]"
    # a query for each round, as aliases within one are expanded over and over
    rounds = "SELECT *, x >> half AS l0, x & mask AS r0 FROM walk WHERE NOT done"
    for i in range(4):
        rounds = f"SELECT *, r{i} AS l{i + 1}, xor(l{i}, f{i}_ & mask) AS r{i + 1} FROM (SELECT *, {mixed(f'xor(r{i}, k{i})', f'f{i}_')} FROM ({rounds}))"
    keyed = ", ".join(mixed(add("key", f"{i}::UBIGINT"), f"k{i}") for i in range(4))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS row_, doc_id, lang, source, text, regexp_extract_all(text, '{blank}*[^ \t\n\r\f]+') AS seg, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text), 1, {_FINE // 4}) AS BIGINT) AS fine FROM documents WHERE text IS NOT NULL),
own AS MATERIALIZED (SELECT *, len(seg) AS n FROM d WHERE len(seg) > 0),
src AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS src, least({_FINE}, greatest(0, ceil(log2(sum(n) / {stream_tokens}.0::DOUBLE))))::BIGINT AS bits FROM own GROUP BY source),
placed AS MATERIALIZED (SELECT own.*, src, fine >> ({_FINE} - bits) AS stream FROM own JOIN src ON src.source IS NOT DISTINCT FROM own.source),
streams AS MATERIALIZED (SELECT src, stream, sum(blocks) OVER (PARTITION BY src ORDER BY stream) - blocks AS base, blocks FROM (SELECT src, stream, CAST(ceil(sum(n) / {block_tokens}.0::DOUBLE) AS BIGINT) AS blocks FROM placed GROUP BY src, stream)),
spread AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY src, stream ORDER BY fine, doc_id NULLS FIRST, text, lang NULLS FIRST, row_) - n AS pos FROM placed),
have AS MATERIALIZED (SELECT src, CAST(sum(blocks) AS BIGINT) AS n FROM streams GROUP BY src),
share AS MATERIALIZED (SELECT src, n, sum(pow(n::DOUBLE, {TEMPERATURE}) / (SELECT sum(pow(n::DOUBLE, {TEMPERATURE}) ORDER BY src) FROM have)) OVER (ORDER BY src) AS upto FROM have),
total AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM have),
slot AS MATERIALIZED (SELECT shard, slot, (m >> 11) * pow(2.0::DOUBLE, -53) AS u FROM (SELECT shard, slot, {mixed(add("s", "slot"), "m")} FROM (SELECT g // {shard_slots} AS shard, g % {shard_slots} AS slot, {mixed(add(f"{start}::UBIGINT", f"(g // {shard_slots})"), "s")} FROM (SELECT unnest(range(n)) AS g FROM total)))),
drawn AS (SELECT shard, slot, least((SELECT count(*) FROM share WHERE upto <= u), (SELECT max(src) FROM share)) AS src FROM slot),
numbered AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY shard, slot) - 1 AS pos FROM drawn),
epoch AS (SELECT shard, slot, numbered.src, n, pos // n AS epoch, (pos % n)::UBIGINT AS x FROM numbered JOIN have USING (src)),
named AS (SELECT src, {mixed(add("CAST('0x' || substr(md5(coalesce('s' || source, '')), 1, 12) AS UBIGINT)", f"{seed}::UBIGINT"), "b")} FROM src),
epochs AS (SELECT src, epoch, {keyed} FROM (SELECT src, epoch, {mixed(add("b", "epoch"), "key")} FROM (SELECT DISTINCT src, epoch FROM epoch) JOIN named USING (src))),
walk AS (
  SELECT shard, slot, epoch.src, epoch.epoch, n::UBIGINT AS n, k0, k1, k2, k3, half, (1::UBIGINT << half) - 1 AS mask, x, false AS done FROM (SELECT *, greatest(1, (length(ltrim(bin(greatest(n - 1, 1)), '0')) + 1) // 2)::UBIGINT AS half FROM epoch) epoch JOIN epochs USING (src, epoch)
  UNION ALL
  SELECT shard, slot, src, epoch, n, k0, k1, k2, k3, half, mask, (l4 << half) | r4, ((l4 << half) | r4) < n FROM ({rounds})),
wanted AS MATERIALIZED (SELECT shard, slot, src, epoch, CAST(x AS BIGINT) AS block FROM walk WHERE done),
cut AS MATERIALIZED (SELECT src, base + number AS block, source, doc_id, lang, seg, greatest(pos, number * {block_tokens}) - pos AS lo, least(pos + n, (number + 1) * {block_tokens}) - pos AS hi, pos FROM (SELECT spread.*, base, unnest(range(CAST(pos // {block_tokens} AS BIGINT), CAST((pos + n - 1) // {block_tokens} + 1 AS BIGINT))) AS number FROM spread JOIN streams USING (src, stream)))
SELECT shard, slot, CAST(row_number() OVER (PARTITION BY shard, slot ORDER BY pos) - 1 AS INTEGER) AS piece, source, epoch, block, doc_id, lang, CAST(hi - lo AS BIGINT) AS n_tokens, regexp_replace(array_to_string(seg[CAST(lo + 1 AS BIGINT):CAST(hi AS BIGINT)], ''), '^{blank}+', '') AS text
FROM wanted JOIN cut USING (src, block)"""
