"""Token counts of documents of any length by overlap resynchronisation.

A long text is cut into chunks that overlap; each chunk is encoded by itself and
tells, for the boundaries in its overlaps that are proven stable, how many of
its tokens lie before them.  Neighbours are spliced at a boundary that is a token
boundary in both encodings; where they have none in common, the document's
overlaps are widened and it is encoded again, at last as one chunk.

Proof for the pattern below: a match holds white space only at its start or
throughout, and none has a letter followed by a sign that is neither letter,
digit nor white space.  So wherever white space follows something visible, or
such a sign follows a letter, a match ends, whatever the rest of the text is;
merges stay within matches, so the tokens on either side are those of the whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.common import cut, per_slice

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STABLE = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}\p{N}])"
CHUNK, OVERLAP, WIDER = 32_768, 256, 8


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, some megabytes at most; it is read where the job is made and goes to the executors with it."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding(content: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a vocabulary, and the number of bytes of each token."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks of a text of n characters; neighbours share 2 * overlap of them.  One chunk where overlaps would meet."""
    if n <= chunk or 2 * overlap >= chunk and 2 * overlap >= n:
        return [(0, n)]
    chunk = max(chunk, 2 * overlap)
    return [(max(0, at - overlap), min(n, at + chunk + overlap)) for at in range(0, n, chunk)]


def boundaries(text: str, start: int, first: int, last: int, content: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(tokens of text, [(position, tokens before it)]) for stable token boundaries.

    start is where text begins in its document; positions are the document's,
    those below first or from last on are left out but for what lies between.
    """
    enc, lengths = encoding(content)
    tokens = np.array(enc.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[tokens])
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    at_byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    found = []
    for lo, hi in ((0, first - start), (last - start, len(text))):
        lo, hi = max(lo, 0), min(hi, len(text))
        if hi - lo >= 2:
            here = np.array([m.start() for m in _stable().finditer(text, lo, hi)], np.int64)
            here = here[(here > lo) & (here < hi)]
            if len(here):
                i = np.searchsorted(ends, at_byte[here])
                ok = (i < len(ends)) & (ends[np.minimum(i, len(ends) - 1)] == at_byte[here])
                found += list(zip((here[ok] + start).tolist(), (i[ok] + 1).tolist()))
    return len(tokens), sorted(set(found))


@lru_cache(maxsize=1)
def _stable() -> regex.Pattern:
    return regex.compile(STABLE)


def splice(chunks: list[tuple[int, int, list[tuple[int, int]], list[tuple[int, int]]]]) -> int | None:
    """Tokens of the whole from (number, tokens, left, right) of its chunks; None where neighbours don't align."""
    chunks = sorted(chunks)
    total, skip = 0, 0
    for (_, tokens, _, right), (_, _, left, _) in zip(chunks, chunks[1:]):
        there = dict(left)
        shared = [(p, n, there[p]) for p, n in right if p in there]
        if not shared:
            return None
        _, before, after = shared[len(shared) // 2]
        if before < skip:  # the splice lies before the chunk's own left one
            return None
        total, skip = total + before - skip, after
    return total + chunks[-1][1] - skip


_BOUND = "array<struct<p:bigint,n:bigint>>"


def _long(docs: DataFrame, chunk: int, overlap: int, held: Broadcast) -> DataFrame:
    """(doc_id, digest, n_tokens, n_chunks, copies); n_tokens is null where chunks don't align."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column("text")[i].as_py()
                parts = spans(len(text), chunk, overlap)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    m = len(some)
                    cols = [pa.array([b.column("doc_id")[i].as_py()] * m, pa.int64()), pa.array([b.column("digest")[i].as_py()] * m), pa.array(range(at, at + m), pa.int64()), pa.array([len(parts)] * m), pa.array([s for s, _ in some]), pa.array([text[s:e] for s, e in some])]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "number", "n_chunks", "start", "text"])

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens, left, right = [], [], []
        for i, s, t, k in zip(b.column("number").to_pylist(), b.column("start").to_pylist(), b.column("text").to_pylist(), b.column("n_chunks").to_pylist()):
            first = s + 2 * overlap if i else s
            last = s + len(t) - 2 * overlap if i < k - 1 else s + len(t)
            n, found = boundaries(t, s, first, last, held.value)
            tokens.append(n)
            left.append([{"p": p, "n": n} for p, n in found if p < first])
            right.append([{"p": p, "n": n} for p, n in found if p > last])
        kind = pa.list_(pa.struct([("p", pa.int64()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "digest", "number", "n_chunks")), pa.array(tokens, pa.int64()), pa.array(left, kind), pa.array(right, kind)], names=["doc_id", "digest", "number", "n_chunks", "tokens", "left", "right"])

    def join_up(b: pa.RecordBatch) -> pa.RecordBatch:
        total = []
        for chunks in b.column("chunks").to_pylist():
            own = {c["number"]: (c["number"], c["tokens"], [(x["p"], x["n"]) for x in c["left"]], [(x["p"], x["n"]) for x in c["right"]]) for c in chunks}
            total.append(splice(list(own.values())))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(total, pa.int64()), b.column("n_chunks"), b.column("copies")], names=["doc_id", "digest", "n_tokens", "n_chunks", "copies"])

    made = docs.mapInArrow(cut_up, "doc_id bigint, digest string, number bigint, n_chunks bigint, start bigint, text string")
    # one huge document's chunks go to many tasks
    spread = made.repartition("digest", "number").mapInArrow(per_slice(encode, 64), f"doc_id bigint, digest string, number bigint, n_chunks bigint, tokens bigint, left {_BOUND}, right {_BOUND}")
    one = spread.groupBy("doc_id", "digest", "number").agg(F.first("n_chunks").alias("n_chunks"), F.first("tokens").alias("tokens"), F.first("left").alias("left"), F.first("right").alias("right"), F.count(F.lit(1)).alias("copies"))
    grouped = one.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("number", "tokens", "left", "right")).alias("chunks"), F.max("n_chunks").alias("n_chunks"), F.max("copies").alias("copies"))
    return grouped.mapInArrow(per_slice(join_up), "doc_id bigint, digest string, n_tokens bigint, n_chunks bigint, copies bigint")


def count_tokens(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, widened) for every row of docs, exactly as if encoded whole.

    widened tells how often the overlaps were widened.  Null and empty texts have
    no tokens and one chunk; repeated rows are counted repeatedly; a null doc_id
    is carried along; special tokens' strings count as ordinary text; other
    columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(held.value)[0]
        n = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([1] * len(n), pa.int64()), pa.array([0] * len(n), pa.int32())], names=["doc_id", "n_tokens", "n_chunks", "widened"])

    out = own.where(~is_long).mapInArrow(per_slice(whole), "doc_id bigint, n_tokens bigint, n_chunks bigint, widened int")
    todo, k = own.where(is_long).withColumn("digest", F.md5("text")), 0
    while True:
        now = cut(_long(todo, chunk, overlap, held))
        done = now.where("n_tokens IS NOT NULL").withColumn("again", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
        out = out.unionByName(done.select("doc_id", "n_tokens", "n_chunks", F.lit(k).cast("int").alias("widened")))
        failed = now.where("n_tokens IS NULL").select(F.col("doc_id").alias("d"), F.col("digest").alias("g"))
        if failed.isEmpty():
            return out
        todo = todo.join(failed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left_semi")
        overlap, k = overlap * WIDER, k + 1
