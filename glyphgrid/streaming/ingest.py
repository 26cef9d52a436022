"""Continuous ingest: bulk files as they arrive, each micro-batch one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphgrid.operators.catalog import Engine


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(value, name): new files of a folder, each a whole bulk body."""
    return spark.readStream.format("text").option("wholetext", "true").load(folder).select("value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("name"))


def stream_bulk(engine: Engine, folder: str, checkpoint: str, index: str | None = None, once: bool = True) -> StreamingQuery:
    """Upserts what arrives in folder.  Of one key the last arrival counts, so late data needs no watermark.

    A batch that is run again after a failure writes the same documents over
    themselves.
    """

    def take(batch: DataFrame, number: int) -> None:
        # bodies are in order of their arrival, then their names
        arrival = F.concat(F.lpad(F.unix_micros("at").cast("string"), 20, "0"), F.lit(" "), F.col("name"))
        engine.bulk(batch.select(arrival.alias("request"), "value"), index)
        engine.maintain()

    writer = read_stream(engine.spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()

