"""Vector bin packing of training examples by the dot-product heuristic.

An example asks for tokens, segments and loss-bearing tokens; a pack holds at
most so many of each.  One pack is open at a time and takes, of the examples
that fit, the one whose demand has the greatest weighted dot product with what
the pack has left (Panigrahy et al. 2011).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.common import cut, parts, runs
from glyphgrid.llm.mixing import token_count

#: Tokens, segments, loss-bearing tokens.
LIMITS = (2048, 16, 1536)
#: Examples are spread by hash over shards of about so many, each packed by itself.
SHARD_ROWS = 4096


def pack_vectors(demand: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pack of each row, whether it fits into a pack at all, which placement it was).

    Rows beyond a limit get a pack of their own.  Ties go to the earlier row.
    """
    n, dims = demand.shape
    size = demand / np.array(limits, np.float64)
    weight = size.mean(0) if n else np.ones(dims)
    pack, fits = np.full(n, -1), (demand <= np.array(limits)).all(1)
    alive = np.flatnonzero(fits)
    exact, scaled, whole = demand[alive], size[alive] * weight, np.array(limits)
    taken = np.zeros(len(alive), bool)
    number, step, when = 0, 0, np.arange(n)
    while len(alive):
        left = whole.copy()
        while True:
            can = (exact <= left).all(1) & ~taken
            if not can.any():
                break
            # 9 decimals, so that a tie is one in any order of summing
            at = int(np.argmax(np.where(can, np.round(scaled @ (left / whole), 9), -1.0)))
            pack[alive[at]], when[alive[at]], taken[at], step = number, step, True, step + 1
            left = left - exact[at]
        keep = ~taken
        alive, exact, scaled, taken = alive[keep], exact[keep], scaled[keep], np.zeros(int(keep.sum()), bool)
        number += 1
    over = np.flatnonzero(~fits)
    pack[over] = number + np.arange(len(over))
    return pack, fits, when


def _shard(shards: int, *more: Column) -> Column:
    """A row's shard by MD5 of its id and demands, which SQL has too."""
    named = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "tokens", "segments", "loss")], *more)
    return F.pmod(F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("bigint"), F.lit(shards))


def pack(examples: DataFrame, limits: tuple[int, int, int] = LIMITS, shard_rows: int = SHARD_ROWS, texts: bool = False) -> DataFrame:
    """(pack_id, ids, n_tokens, n_segments, n_loss, fits[, texts]): a row for each pack.

    examples has id, tokens, segments and loss (and text, with texts).  ids and
    texts list the pack's examples in order of placement.  An example beyond a
    limit is never cut: it has a pack of its own with fits false.  Null demands
    count as 0; null ids are carried along; repeated rows are packed repeatedly,
    those with more copies than a shard has rows in several shards; equal dot
    products go to the lesser id, then demands; an empty table gives no packs.
    Other columns, whatever their names, are ignored.
    """
    spark = examples.sparkSession
    demand = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("tokens", "segments", "loss")]
    own = examples.select(F.col("id").cast("bigint").alias("id"), *demand, *([F.coalesce("text", F.lit("")).alias("text")] if texts else []))
    if not texts:
        own = cut(own)
    alike = own.groupBy("id", "tokens", "segments", "loss").agg(F.count(F.lit(1)).alias("n"))
    sizes = alike.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    shards = max(1, -(-(sizes["rows"] or 0) // shard_rows))
    columns = own.columns
    if (sizes["most"] or 0) <= shard_rows:
        spread = own.withColumn("shard", _shard(shards))
    else:
        # rows that hash alike but for their text first meet as counts, and are dealt out again in parts
        hot = cut(alike.where(F.col("n") > shard_rows).select("id", "tokens", "segments", "loss"))
        same = reduce(lambda a, b: a & b, [own[c].eqNullSafe(hot[c]) for c in hot.columns])
        few = own.join(hot, same, "left_anti").withColumn("shard", _shard(shards))
        many = own.join(hot, same, "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        part = many.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        parts_ = _shard(shards, F.floor(F.col("i") / F.lit(max(1, shard_rows // 2))).cast("string"), *([F.md5("text")] if texts else []))
        spread = few.unionByName(part.withColumn("shard", parts_).select(*columns, "shard"))
    order = ["shard", "id", "tokens", "segments", "loss"] + ["text"] * texts
    tasks = min(shards, max(parts(spark), -(-shards // 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "shard"):
            shard = group.column("shard").to_numpy()
            ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard))
            start = 0
            for end in ends:
                b = group.slice(start, end - start)
                want = np.stack([b.column(c).to_numpy() for c in ("tokens", "segments", "loss")], 1)
                to, fits, when = pack_vectors(want, limits)
                order_ = np.lexsort((when, to))
                first = np.flatnonzero(np.diff(to[order_], prepend=-1))
                offsets = pa.array(np.append(first, len(to)), pa.int32())
                rows = pa.array(order_)
                sums = np.add.reduceat(want[order_], first)
                cols = [pa.array((int(shard[start]) << 32) + to[order_][first]), pa.ListArray.from_arrays(offsets, b.column("id").take(rows)), *(pa.array(sums[:, i]) for i in range(3)), pa.array(fits[order_][first])]
                names = ["pack_id", "ids", "n_tokens", "n_segments", "n_loss", "fits"]
                if texts:
                    cols.append(pa.ListArray.from_arrays(offsets, b.column("text").take(rows)))
                    names.append("texts")
                yield pa.RecordBatch.from_arrays(cols, names=names)
                start = end

    kind = "pack_id bigint, ids array<bigint>, n_tokens bigint, n_segments bigint, n_loss bigint, fits boolean" + ", texts array<string>" * texts
    # the number of tasks goes with the shards, each much work and few bytes
    return spread.repartition(tasks, "shard").sortWithinPartitions(*order).mapInArrow(run, kind)


def members(packs: DataFrame) -> DataFrame:
    """(pack_id, place, id, n_tokens, n_segments, n_loss, fits): the packs with a row for each example, placed from 0."""
    return packs.select("pack_id", F.posexplode("ids").alias("place", "id"), "n_tokens", "n_segments", "n_loss", "fits")


def conversation_examples(conversations: DataFrame) -> DataFrame:
    """(id, tokens, segments, loss): one example for each conversation.

    Its segments are its turns, its tokens those of all turns and its
    loss-bearing tokens those of the assistant's.  Turns with a null conv_id make
    one example; null texts and roles count as turns without tokens or loss.
    """
    n = token_count()
    return conversations.groupBy(F.col("conv_id").cast("bigint").alias("id")).agg(F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("loss"))


def document_examples(docs: DataFrame) -> DataFrame:
    """(id, tokens, segments, loss, text): a document is one segment whose words all bear loss but the first."""
    n = token_count()
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), n.alias("tokens"), F.lit(1).alias("segments"), F.greatest(n - 1, F.lit(0)).alias("loss"), "text")


def sql(limits: tuple[int, int, int] = LIMITS, shard_rows: int = SHARD_ROWS) -> str:
    """members() of the packs of conversation_examples() in DuckDB SQL: the heuristic as a recursion, one placement a step in every shard."""
    a, b, c = limits
    score = lambda x: f"round({x}.t / {a}.0::DOUBLE * w0 * (l0 / {a}.0::DOUBLE) + {x}.s / {b}.0::DOUBLE * w1 * (l1 / {b}.0::DOUBLE) + {x}.l / {c}.0::DOUBLE * w2 * (l2 / {c}.0::DOUBLE), 9)"
    n = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
    return f"""
WITH RECURSIVE ex AS MATERIALIZED (SELECT conv_id AS id, CAST(sum(coalesce({n}, 0)) AS BIGINT) AS t, count(*) AS s, CAST(sum(CASE WHEN role = 'assistant' THEN coalesce({n}, 0) ELSE 0 END) AS BIGINT) AS l FROM conversations GROUP BY conv_id),
placed AS MATERIALIZED (SELECT *, CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(id AS VARCHAR), ''), t, s, l)), 1, 12) AS BIGINT) % greatest(1, (SELECT ceil(count(*) / {shard_rows}.0) FROM ex))::BIGINT AS shard FROM ex),
item AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY id NULLS FIRST, t, s, l) AS rn, t <= {a} AND s <= {b} AND l <= {c} AS fits FROM placed),
start AS (SELECT shard, list({{'rn': rn, 't': t, 's': s, 'l': l}} ORDER BY rn) FILTER (fits) AS rest, avg(t / {a}.0::DOUBLE) AS w0, avg(s / {b}.0::DOUBLE) AS w1, avg(l / {c}.0::DOUBLE) AS w2 FROM item GROUP BY shard),
run AS (
  SELECT shard, 0::BIGINT AS step, 0::BIGINT AS pack, {a}::BIGINT AS l0, {b}::BIGINT AS l1, {c}::BIGINT AS l2, coalesce(rest, []) AS rest, w0, w1, w2, NULL::BIGINT AS took FROM start
  UNION ALL
  SELECT shard, step + 1, CASE WHEN best IS NULL THEN pack + 1 ELSE pack END, CASE WHEN best IS NULL THEN {a} ELSE l0 - best.t END, CASE WHEN best IS NULL THEN {b} ELSE l1 - best.s END, CASE WHEN best IS NULL THEN {c} ELSE l2 - best.l END,
         CASE WHEN best IS NULL THEN rest ELSE list_filter(rest, lambda x: x.rn <> best.rn) END, w0, w1, w2, best.rn
  FROM (SELECT *, CASE WHEN len(can) > 0 THEN list_reduce(can, lambda p, q: CASE WHEN {score('q')} > {score('p')} THEN q ELSE p END) END AS best
        FROM (SELECT *, list_filter(rest, lambda x: x.t <= l0 AND x.s <= l1 AND x.l <= l2) AS can FROM run WHERE len(rest) > 0))),
put AS (SELECT r.shard, r.pack, row_number() OVER (PARTITION BY r.shard, r.pack ORDER BY r.step) - 1 AS place, i.id, i.t, i.s, i.l, true AS fits FROM run r JOIN item i ON i.shard = r.shard AND i.rn = r.took
        UNION ALL
        SELECT i.shard, coalesce(m.packs, 0) + row_number() OVER (PARTITION BY i.shard ORDER BY i.rn) - 1, 0, i.id, i.t, i.s, i.l, false FROM item i LEFT JOIN (SELECT shard, max(pack) + 1 AS packs FROM run WHERE took IS NOT NULL GROUP BY shard) m ON m.shard = i.shard WHERE NOT i.fits)
SELECT CAST(shard * 4294967296 + pack AS BIGINT) AS pack_id, CAST(place AS INTEGER) AS place, id, CAST(sum(t) OVER w AS BIGINT) AS n_tokens, CAST(sum(s) OVER w AS BIGINT) AS n_segments, CAST(sum(l) OVER w AS BIGINT) AS n_loss, fits
FROM put WINDOW w AS (PARTITION BY shard, pack)"""
