"""A training corpus from documents: quality, near copies, mixture, packs.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes a
stage's rows as Parquet in the shared checkpoint folder and reads them again as
the next one's docs; what a later stage has read is removed once that is written.

In every stage repeated rows are judged alike or, for near copies, as one document;
ties go to the lesser doc_id; a null doc_id, lang or source is carried along; null
and blank texts go in the first stage; columns but the five of documents are left
out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphgrid.llm import mixing, neardup, packing, quality
from glyphgrid.llm.common import remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those labelled, keeps; the rest and blank texts go.  Equal texts score alike."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id, of its rows that of least text."""
    return neardup.drop_near(docs).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed blocks, each piece of a document in a block a document with the same doc_id.

    There are so many slots that every source completes an epoch, so that no
    document is left out; those of smaller sources come again.
    """
    return mixing.mixed_documents(docs, epochs=1.0).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs (pack_id, ids, n_tokens, n_segments, n_loss, fits, texts); ids are doc_ids."""
    return packing.pack(packing.document_examples(docs), limits=(2048, 16, 2048), texts=True)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier, MinHash and the permutations are not SQL; tests/llm compares with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs made of sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove(spark, before)
            before = f"{folder}/{name}"
    return docs
