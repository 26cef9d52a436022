"""What the operators of this subpackage share: Arrow batch functions and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that are held as Python objects at once.
ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set a temporary one, on a local master alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphgrid-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, where cut() computes what follows its last shuffle twice."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies fn to slices of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: str, most: int | None = None) -> Iterator[pa.RecordBatch | int]:
    """Batches sorted by an integer column, cut between its values.

    With most, a value of more rows than that comes as the bare value instead, and
    its rows aren't held.
    """
    held: list[pa.RecordBatch] = []
    rows, hot, open_ = 0, False, None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(keys).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        first = 0
        if open_ == k[0]:
            if not hot:
                held.append(b.slice(0, starts[1]))
                rows += int(starts[1])
                if most is not None and rows > most:
                    yield int(open_)
                    held, hot = [], True
            first = 1
        if first < len(starts) - 1:  # a new value begins here, so the open one is complete
            if held:
                yield pa.concat_batches(held)
            held, rows, hot = [], 0, False
            sizes = np.diff(starts)
            at = starts[first]
            if most is not None:
                for i in np.flatnonzero(sizes[first:-1] > most) + first:
                    if starts[i] > at:
                        yield b.slice(at, starts[i] - at)
                    yield int(k[starts[i]])
                    at = starts[i + 1]
            if starts[-2] > at:
                yield b.slice(at, starts[-2] - at)
            held, rows, open_ = [b.slice(starts[-2])], int(sizes[-1]), k[-1]
        if most is not None and rows > most and not hot:
            yield int(open_)
            held, hot = [], True
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids(df: DataFrame, name: str) -> DataFrame:
    """The column as a non-null bigint, alone."""
    return df.select(F.col(name).cast("bigint").alias(name)).where(F.col(name).isNotNull())
