"""Structured Streaming forms of the live views. Sources are folders of files that grow; state is bounded by watermarks.

Every function takes a streaming DataFrame and returns one, or a query that it has started; `drain` runs what is
there and stops, which is how a scheduled job catches up.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.tables import bounded, latest_per_key
from millrace.sources.commits import Store
from millrace.sources.shared import new_path
from millrace.sources.sinks import read_or_empty


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, files: int = 50) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def drain(df: DataFrame, sink: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Writes all that is available to Parquet under `sink`, exactly once per checkpoint, and reads it back."""
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint or new_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(sink)


def tumbling_counts(events: DataFrame, ts: str, by: list[str], length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window and key; a window is written when the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding_counts(events: DataFrame, ts: str, by: list[str], length: str = "24 hours", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, step), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Exact repeats go; state is kept as long as the watermark allows repeats."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


#: The table of keep_latest's store.
LOG = "log"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream; a new checkpoint is a new stream, also in the same place."""
    return json.loads("".join(r.value for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"]


def keep_latest(events: DataFrame, keys: list[str], order: list[str], sink: str, checkpoint: str | None = None, compact: int = 20) -> DataFrame:
    """The newest row per key, kept as a log below `sink` (a commits.Store), which several streams may fill.

    A batch adds its own newest rows, so its cost does not grow with the state; after `compact` batches the log is
    merged into one entry. An entry is named for its stream and batch: a batch that runs twice changes nothing, and
    a stream with another checkpoint, or one that has lost it and reads all again, adds entries of its own. With its
    checkpoint (by default beside the sink) a stream goes on where it stopped.
    """
    spark, at = events.sparkSession, checkpoint or f"{sink}-checkpoint"
    store = Store(spark, sink, keep=compact + 2)
    newest = lambda rows: latest_per_key(rows, keys, order).select(*rows.columns)

    def add(batch: DataFrame, epoch: int) -> None:
        stream = stream_id(spark, at)
        log = store.state()[1].get(LOG)
        if log is None or (f"{stream}-{epoch}" not in {e["tag"] for e in log["entries"]} and epoch > log["notes"].get(stream, -1)):
            with store.transaction() as t:
                t.append(LOG, newest(batch), f"{stream}-{epoch}")
        if len(store.state()[1][LOG]["entries"]) > compact:
            store.merge(LOG, newest, _merged)

    run_batches(events, add, at)
    return latest_state(spark, sink, events.schema, keys, order)


def _merged(log: dict) -> dict[str, int]:
    """The last batch of each stream among the entries of a log."""
    tags = [e["tag"].rsplit("-", 1) for e in log["entries"] if e["tag"]]
    return {stream: max(int(n) for s, n in tags if s == stream) for stream, _ in tags}


def latest_state(spark: SparkSession, sink: str, schema: T.StructType, keys: list[str], order: list[str]) -> DataFrame:
    """What keep_latest has stored."""
    return latest_per_key(Store(spark, sink).read(LOG, schema), keys, order).select(*schema.names)


def replace_touched(events: DataFrame, day: str, version: str, sink: str, checkpoint: str | None = None) -> DataFrame:
    """Of each day the rows of its newest version: corrected data replaces the days that it brings, and no other.

    version is a column of the events that names the delivery (a landing time or number). The rows of a delivery may
    come in any number of batches; each batch has a folder of its own below day and version, which it overwrites
    when it runs again.
    """
    spark = events.sparkSession
    at = checkpoint or f"{sink}-checkpoint"
    source = hashlib.sha256(at.encode()).hexdigest()[:12]

    def store(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("batch", F.lit(f"{source}-{epoch}"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, version, "batch").parquet(sink)

    run_batches(events, store, at)
    return newest_version(spark, sink, events.schema, day, version)


def newest_version(spark: SparkSession, sink: str, schema: T.StructType, day: str, version: str) -> DataFrame:
    """What replace_touched has stored, without the days that a newer version replaced."""
    rows = read_or_empty(spark, sink, T.StructType([*schema, T.StructField("batch", T.StringType())]))
    newest = rows.groupBy(day).agg(F.max(version).alias(version))  # from the names of folders; one row per day
    return rows.join(bounded(newest), [day, version]).select(*schema.names)


def run_batches(events: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def snapshot(state: DataFrame, ts: str, now: str, minutes: int = 90) -> DataFrame:
    """Rows of the state within +- minutes of now."""
    at = F.lit(now).cast("timestamp_ntz")
    span = F.expr(f"interval {minutes} minutes")
    return state.filter((F.col(ts) >= at - span) & (F.col(ts) <= at + span))


def freshness(df: DataFrame, ts: str, now: str, limit_hours: int = 30) -> DataFrame:
    """Age of the newest row; old data warns and never blocks."""
    age = F.round((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(ts).cast("timestamp"))) / 3600, 2)
    return df.agg(age.alias("age_hours")).withColumn("status", F.when(F.col("age_hours") > limit_hours, "WARN").otherwise("PASS"))
