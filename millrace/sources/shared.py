"""Intermediate tables in the folder that driver and executors share.

``stage`` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back: lineage ends at
files that every executor can read, so a lost executor costs one task and not the whole plan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder. Where the setting is missing, a local master gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(path := f"{root(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def clear(spark: SparkSession) -> None:
    """Deletes what this process has staged. Frames that read it are of no use afterwards."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast.

    Spark takes what is read from a staged table to be as large as its files. Rows that are made of lists there, or of
    texts that repeat, are a hundred times that, and the driver would collect them.
    """
    return df.hint("merge")


_SPLIT = "spark.sql.files.maxPartitionBytes"


@contextmanager
def small_reads(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """What is staged inside reads at most `size` bytes of files in a task. A task that deals rows to many others keeps all
    that it has read in memory, and 128 MB of narrow columns are close to a GB of rows.

    The session's own setting is there again afterwards.
    """
    before = spark.conf.get(_SPLIT)
    spark.conf.set(_SPLIT, str(min(size, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())))
    try:
        yield
    finally:
        spark.conf.set(_SPLIT, before)
