"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrid.llm import compression, flac, hostrank, licenses, mixing, neardup, packing, quality, rabitq, tokencount
from glyphgrid.llm.common import table


def op1_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrank.filter_pages(table(spark, sf_dir, "pages"))


def host_rank_trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of op1 on a graph with links between hosts, which pages have none of."""
    return hostrank.trade_ranks(*(table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")))


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's bytes as a FLAC recording, decoded again."""
    turns = flac.spoken(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return flac.decode(turns).select("conv_id", "turn", "block", "sample_offset", "n_samples", "crc_ok", F.col("stream_ok").cast("string").alias("stream_ok"), F.hex("pcm").alias("pcm"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of op3's classes within its radius, with their distances."""
    return neardup.pairs(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations packed, a row for each with its place in its pack."""
    return packing.members(packing.pack(packing.conversation_examples(table(spark, sf_dir, "conversations"))))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row for each piece of a document in a block."""
    return mixing.pieces(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 50."""
    return rabitq.neighbours(table(spark, sf_dir, "embeddings"))


def op9_compression_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain is dialogue: all turns of conversations."""
    return compression.cross_entropy(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: f for n, f in globals().items() if n.startswith("op")}
    return own | {"host_rank_trade_graph": host_rank_trade_graph, "near_pairs": near_pairs}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_host_rank": hostrank.sql(),
        "host_rank_trade_graph": hostrank.trade_sql(),
        "op3_minhash_near_dedup": neardup.sql(),
        "near_pairs": neardup.sql("pairs"),
        "op4_packing": packing.sql(),
        "op6_mixing": mixing.sql(),
        "op8_rotated_codes": rabitq.sql(),
        "op10_license_scan": licenses.sql(),
        "op2_flac": """
            WITH t AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations)
            SELECT conv_id, turn, b AS block, b * 1024 AS sample_offset, least(1024, length(h) // 2 - b * 1024) AS n_samples,
                   true AS crc_ok, CASE WHEN b = (length(h) // 2 - 1) // 1024 THEN 'true' END AS stream_ok, substr(h, CAST(b * 2048 + 1 AS BIGINT), 2048) AS pcm
            FROM t, unnest(range((length(h) // 2 + 1023) // 1024)) AS u(b)""",
    }
