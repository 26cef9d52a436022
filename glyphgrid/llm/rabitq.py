"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector less its cell's centre, padded and rotated at random, keeps one bit a
dimension and three scalars (RaBitQ, Gao & Long 2024).  A query, rotated alike and
quantised to four bits a dimension, meets the packed bits by AND and popcount; the
estimate has an error bound, and only vectors whose bound reaches the query's k-th
best so far are compared exactly.

The index is a table of codes beside vectors, sorted by cell, that no shuffle
touches again.  Queries go to it in waves of bounded size, broadcast; each task
keeps every query's best k of its rows.  A k-th best among a bounded sample is
where the bar begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphgrid.llm.common import cut, parts, per_slice

K, EVERY, EPSILON, SEED = 10, 50, 3.0, 11
#: Cells of about so many rows; the centres, at most so many, are broadcast.
CELL_ROWS, MAX_CELLS = 4096, 16_384
#: Rows of least hash that the centres and first bars are fitted on, at most, and bytes of queries in a wave.
SAMPLE_ROWS, SAMPLE_BYTES, WAVE_BYTES = 65_536, 1 << 26, 1 << 25
_PLANES, _TILE = 4, 1 << 20


def rotation(dims: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(dims, bits): orthonormal rows, the first dims of a random rotation of bits dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dims].astype(np.float32)


def code_bits(dims: int) -> int:
    """Two bits a dimension, in whole words of 64."""
    return -(-2 * dims // 64) * 64


class Codes:
    """Packed bits (rows, words) and correction scalars of vectors around a centre."""

    def __init__(self, bits: np.ndarray, scale: np.ndarray, spread: np.ndarray, shift: np.ndarray, norm: np.ndarray):
        self.bits, self.scale, self.spread, self.shift, self.norm = bits, scale, spread, shift, norm

    @classmethod
    def of(cls, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        d = turn.shape[1]
        rest = vectors - centre
        norm = np.linalg.norm(rest, axis=1)
        turned = (rest @ turn) / np.maximum(norm, 1e-12)[:, None]
        bits = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
        # the code's inner product with the vector it stands for
        own = np.maximum(np.abs(turned).sum(1) / np.sqrt(d), 1e-6)
        spread = norm * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(d - 1)
        # <x, q> = <x - c, q - c> + <c, q> + <x, c> - <c, c>
        shift = vectors @ centre - (centre * centre).sum(-1) if centre.ndim == 1 else ((vectors - centre) * centre).sum(1)
        return cls(bits, norm / (own * np.sqrt(d)), spread, shift, norm)

    def estimate(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """(inner products, error bounds), each (queries, vectors), from the bits alone."""
        rest = queries - centre
        turned = rest @ turn
        low = turned.min(1, keepdims=True)
        step = np.maximum(turned.max(1, keepdims=True) - low, 1e-12) / ((1 << _PLANES) - 1)
        level = np.rint((turned - low) / step).astype(np.uint8)
        total = np.zeros((len(queries), len(self.bits)), np.uint16)
        for plane in range(_PLANES - 1, -1, -1):
            mask = np.packbits(level >> plane & 1, axis=1, bitorder="little").view("<u8")
            total <<= np.uint16(1)
            for word in range(mask.shape[1]):
                total += np.bitwise_count(mask[:, word, None] & self.bits[None, :, word])
        ones = np.bitwise_count(self.bits).sum(1, dtype=np.float32)
        # the sum of the query's dimensions under set bits, less those under the rest
        guess = total.astype(np.float32)
        guess *= (2 * step).astype(np.float32)
        guess += (2 * low).astype(np.float32) * ones
        guess -= turned.sum(1, keepdims=True).astype(np.float32)
        guess *= self.scale.astype(np.float32)
        guess += (queries @ centre)[:, None].astype(np.float32) + self.shift.astype(np.float32)
        far = np.linalg.norm(rest, axis=1, keepdims=True)
        rounded = step * np.sqrt(turn.shape[1] / 12)
        err = (epsilon * far).astype(np.float32) * self.spread.astype(np.float32)
        err += (epsilon * rounded).astype(np.float32) * self.scale.astype(np.float32)
        err += np.float32(1e-5) * (1 + np.abs(guess))
        return guess, err


class Best:
    """Each query's best k so far: inner products of 6 decimals, ties to the lesser id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, bar: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.bar = ids, queries, k, bar.copy()
        self.row, self.neighbour, self.ip = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, row: np.ndarray, neighbour: np.ndarray, ip: np.ndarray) -> None:
        row, neighbour, ip = np.append(self.row, row), np.append(self.neighbour, neighbour), np.append(self.ip, ip)
        order = np.lexsort((neighbour, -ip, row))
        row, neighbour, ip = row[order], neighbour[order], ip[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.neighbour, self.ip = row[keep], neighbour[keep], ip[keep]
        last = place == self.k - 1
        self.bar[row[last]] = np.maximum(self.bar[row[last]], ip[last])

    def visit(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> None:
        """Looks through vectors of one cell for all queries that its sphere can serve."""
        reach = self.queries @ centre + codes.norm.max() * np.linalg.norm(self.queries, axis=1) + 1e-4
        live = np.flatnonzero(reach >= self.bar)
        step = max(1, _TILE // max(len(ids), 1))
        for at in range(0, len(live), step):
            some = live[at : at + step]
            q = self.queries[some]
            guess, err = codes.estimate(q, centre, turn, epsilon)
            err += guess
            r, c = np.nonzero(err >= (self.bar[some] - 2e-6)[:, None])
            if len(r) > 0.25 * guess.size:
                exact = (q.astype(np.float64) @ vectors.T.astype(np.float64))[r, c]
            else:
                exact = np.einsum("ij,ij->i", q[r].astype(np.float64), vectors[c].astype(np.float64))
            exact = np.round(exact, 6)
            ok = (exact >= self.bar[some[r]] - 1e-9) & (self.ids[some[r]] != ids[c])
            self.add(some[r[ok]], ids[c[ok]], exact[ok])


def _vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that can be compared."""
    v = F.col("embedding").cast("array<float>")
    ok = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18))
    return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(ok)


def centres(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Lloyd's k-means from the first rows of the sample; a cell that empties keeps its centre."""
    c = sample[:cells].copy()
    for _ in range(rounds if cells > 1 else 1):
        near = np.concatenate([np.argmin((c * c).sum(1)[None, :] - 2 * part @ c.T, axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c, np.float64)
        np.add.at(total, near, sample)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c).astype(np.float32)
    return c


def first_bars(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best inner product among the sample, which its true one is no less than."""
    bar = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), 256):
        s = queries[at : at + 256].astype(np.float64) @ sample.T.astype(np.float64)
        s[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        if s.shape[1] > k:
            bar[at : at + 256] = np.round(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], 6)
    return bar


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


_INDEX = "cell int, vec_id bigint, code binary, scale float, spread float, shift float, norm float, v array<float>"


def build_index(own: DataFrame, middle: np.ndarray, turn: np.ndarray) -> DataFrame:
    """(cell, vec_id, code, scale, spread, shift, norm, v) of every row (vec_id, v)."""
    held, dims = own.sparkSession.sparkContext.broadcast((middle, turn)), len(turn)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        c, t = held.value
        x = _matrix(b.column("v"), dims)
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        codes = Codes.of(x, c[near], t)
        return pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column("vec_id"), pa.array([y.tobytes() for y in codes.bits], pa.binary()), *(pa.array(y.astype(np.float32)) for y in (codes.scale, codes.spread, codes.shift, codes.norm)), b.column("v")], names=["cell", "vec_id", "code", "scale", "spread", "shift", "norm", "v"])

    return own.select("vec_id", "v").mapInArrow(per_slice(place, 4096), _INDEX)


def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, epsilon: float = EPSILON, cell_rows: int = CELL_ROWS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(vec_id, rank, neighbour, inner_product): the k best others, among all rows, of every row whose vec_id is divisible by every.

    Rows with a null vec_id, or a vector that is null, empty, of another length
    than most, or has a null or NaN, are neither queries nor neighbours.  Ties go
    to the lesser vec_id (inner products have 6 decimals).  Rows that repeat a
    vec_id are one vector, the greatest; with fewer than k others there are fewer
    rows.  Other columns are ignored.  A neighbour is missed only where its
    estimate is off by more than epsilon deviations.
    """
    spark = vectors.sparkSession
    own = cut(_vectors(vectors).groupBy("vec_id").agg(F.max("v").alias("v")))
    kinds = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "vec_id bigint, rank int, neighbour bigint, inner_product double")
    if kinds is None:
        return empty
    dims, count = kinds["d"], kinds["count"]
    own = own.where(F.size("v") == dims)
    turn = rotation(dims, code_bits(dims))
    cells = max(1, min(MAX_CELLS, count // cell_rows))
    rows = max(cells, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * dims), max(4096, 16 * cells)))
    # at most SAMPLE_ROWS rows come to the driver
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toArrow().combine_chunks()
    sample_ids, seen = sample.column("vec_id").to_numpy(), _matrix(sample.column("v").combine_chunks(), dims)
    middle = centres(seen, cells)
    index = cut(build_index(own, middle, turn).repartition(max(parts(spark), -(-count // 65_536)), "vec_id").sortWithinPartitions("cell"))

    asked = own.where(F.col("vec_id") % every == 0)
    total = asked.count()
    waves = max(1, -(-total * dims * 4 // wave_bytes))
    found = []
    for wave in range(waves):
        # a wave's queries, at most about wave_bytes of them, are on the driver and broadcast
        one = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(waves)) == wave).toArrow().combine_chunks()
        if not one.num_rows:
            continue
        q_ids, q = one.column("vec_id").to_numpy(), _matrix(one.column("v").combine_chunks(), dims)
        held = spark.sparkContext.broadcast((q_ids, q, first_bars(q_ids, q, sample_ids, seen, k), middle, turn))

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q_ids, q, bar, middle, turn = held.value
            best = Best(q_ids, q, bar, k)
            for b in batches:
                cell = b.column("cell").to_numpy()
                edges = np.flatnonzero(np.diff(cell)) + 1
                for s, e in zip(np.append(0, edges), np.append(edges, len(cell))):
                    if e > s:
                        part = b.slice(s, e - s)
                        bits = np.frombuffer(b"".join(part.column("code").to_pylist()), "<u8").reshape(e - s, -1)
                        codes = Codes(bits, *(part.column(c).to_numpy() for c in ("scale", "spread", "shift", "norm")))
                        best.visit(part.column("vec_id").to_numpy(), _matrix(part.column("v"), dims), codes, middle[cell[s]], turn, epsilon)
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.row]), pa.array(best.neighbour), pa.array(best.ip)], names=["vec_id", "neighbour", "inner_product"])

        got = index.mapInArrow(look, "vec_id bigint, neighbour bigint, inner_product double")
        found.append(cut(got) if waves > 1 else got)
        if waves > 1:
            held.destroy()
    if not found:
        return empty
    order = Window.partitionBy("vec_id").orderBy(F.desc("inner_product"), "neighbour")
    # a query has at most k rows from each task
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "rank", "neighbour", "inner_product")


def sql(k: int = K, every: int = EVERY) -> str:
    """All inner products of the query rows, in DuckDB, over the view embeddings."""
    return f"""
        WITH own AS MATERIALIZED (SELECT vec_id, max(embedding)::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x)), true) GROUP BY vec_id),
        same AS MATERIALIZED (SELECT * FROM own WHERE len(v) = (SELECT len(v) FROM own GROUP BY len(v) ORDER BY count(*) DESC, len(v) LIMIT 1)),
        p AS (SELECT q.vec_id, t.vec_id AS neighbour, round(list_inner_product(q.v, t.v), 6) AS inner_product FROM same q JOIN same t ON q.vec_id <> t.vec_id WHERE q.vec_id % {every} = 0)
        SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY inner_product DESC, neighbour) AS INTEGER) AS rank, neighbour, inner_product
        FROM p QUALIFY rank <= {k}"""
