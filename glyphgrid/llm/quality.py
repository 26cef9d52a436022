"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal.

Features are word unigrams and bigrams (runs of letters and digits, and runs of
other visible characters) hashed into ``2**bits`` slots; a bigram of one word
twice falls into a slot of its own, whatever the word.  A document's value in a
slot is the count there over the square root of all its counts, so that scoring
is one sparse dot product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.common import cut, per_slice
from glyphgrid.llm.wordhash import mix, ngrams, word_hashes

BITS = 18
#: At most so many labelled rows train the model, those of the least hash.
TRAIN_ROWS = 8192
_TWICE = np.uint64(0x5BD1E995)


def hashed(texts: list[str | None], bits: int = BITS) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Yields (first text, [(slots, offsets) of unigrams, of bigrams])."""
    shift = np.uint64(64 - bits)
    for first, offsets, h in word_hashes(texts, symbols=True):
        two, to = ngrams(h, offsets, 2)
        lens = np.diff(offsets)
        if len(h) > 1:
            same = np.append(h[1:] == h[:-1], False)
            # a text of one word has one run, which is no bigram
            at = np.repeat(offsets[:-1] - to[:-1], np.diff(to)) + np.arange(to[-1])
            two = np.where(same[at] & np.repeat(lens > 1, np.diff(to)), _TWICE, two)
        yield first, [((mix(h) >> shift).astype(np.int64), offsets), ((mix(two) >> shift).astype(np.int64), to)]


def _sums(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.zeros(len(to) - 1)
    full = np.flatnonzero(np.diff(to))
    if len(full):
        out[full] = np.add.reduceat(values, to[full])
    return out


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The probability of good quality for each text; weights: the bias, then a weight for each slot."""
    bits = int(math.log2(len(weights) - 1))
    out = np.zeros(len(texts))
    w = weights[1:].astype(np.float64)
    for first, grams in hashed(texts, bits):
        n = sum(np.diff(to) for _, to in grams)
        total = sum(_sums(w[slots], to) for slots, to in grams)
        z = weights[0] + total / np.sqrt(np.maximum(n, 1))
        out[first : first + len(n)] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -35, 35))), 0)
    return out


class Ftrl:
    """FTRL-proximal logistic regression (McMahan et al. 2013) over sparse rows."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
        g = (p - y) * x * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Weights from rows of (slots, counts, label), seen in order; both classes weigh the same in all."""
    model = Ftrl((1 << bits) + 1)
    good = sum(y for *_, y in rows)
    per = {1: len(rows) / (2 * good) if good else 1.0, 0: len(rows) / (2 * (len(rows) - good)) if good < len(rows) else 1.0}
    for _ in range(epochs):
        for slots, counts, y in rows:
            if len(slots):
                x = np.append(1.0, counts / math.sqrt(counts.sum()))
                model.learn(np.append(0, slots + 1), x, y, per[y])
    return model.weights().astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Fits the weights on labelled documents.

    ``rows`` bounds the labelled sample: of the documents that are there and
    labelled, those of least hash of doc_id, whatever the size of the corpus.
    Labels with a null doc_id or quality are left out; a doc_id labelled twice
    counts once, with its least quality.  Of rows that repeat a doc_id the one of
    least text (null texts last) is learnt from; equal hashes go by doc_id.
    Without labels of documents that are there all weights are 0.  Columns but
    doc_id, text and quality are ignored.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.min("quality") > 0).cast("int").alias("y"))
    )
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # ids alone meet the labels; the sample is bounded after that
    there = own.select("doc_id").where("doc_id IS NOT NULL").distinct().join(known, "doc_id")
    sample = cut(there.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows))
    # at most `rows` small rows, so broadcasting them is safe at every size
    labelled = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text")).select("h", "doc_id", "y", "text")

    def extract(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        slots: list[list[int]] = [[]] * len(texts)
        counts: list[list[int]] = [[]] * len(texts)
        for first, grams in hashed(texts, bits):
            for i in range(len(grams[0][1]) - 1):
                u, c = np.unique(np.concatenate([s[to[i] : to[i + 1]] for s, to in grams]), return_counts=True)
                slots[first + i], counts[first + i] = u, c
        return pa.RecordBatch.from_arrays([b.column("h"), b.column("doc_id"), b.column("y"), pa.array(slots, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["h", "doc_id", "y", "slots", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            s, c, y = b.column("slots"), b.column("counts"), b.column("y").to_pylist()
            for i in range(b.num_rows):
                seen.append((s[i].values.to_numpy().astype(np.int32), c[i].values.to_numpy().astype(np.float32), y[i]))
        yield pa.RecordBatch.from_arrays([pa.array([fit(seen, bits, epochs).tobytes()], pa.binary())], names=["w"])

    features = labelled.mapInArrow(per_slice(extract), "h bigint, doc_id bigint, y int, slots array<bigint>, counts array<bigint>")
    found = features.repartition(1).sortWithinPartitions("h", "doc_id", "slots").mapInArrow(learn, "w binary").collect()
    return np.frombuffer(bytes(found[0]["w"]), np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) for every row of docs, repeated ones too.

    The score has 6 decimals; keep means score >= threshold.  A text that is
    null or has no visible character scores 0 and is not kept.  A null doc_id is
    carried along.  Texts are scored whole, whatever their length; other columns
    are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = np.round(scores(b.column("text").to_pylist(), held.value), 6)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(per_slice(run), "doc_id bigint, score double, keep boolean")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score keeps, with all their columns, in one pass without a join."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = np.round(scores(b.column(b.schema.get_field_index("text")).to_pylist(), held.value), 6)
        return b.filter(pa.array(p >= threshold))

    return docs.mapInArrow(per_slice(run), docs.schema)
