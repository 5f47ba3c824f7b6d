"""Streams of calls: exactly-once keys, windows of time, run windows. An extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_calls(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(calls: DataFrame, key: str, at: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Each key once: a repeat within the watermark is dropped, and state older than it is forgotten.

    Rows that come later than the watermark are lost. Without one (late None) none is, in whatever
    order they come, and the state keeps every key.
    """
    if late is None:
        return calls.dropDuplicates([key])
    return calls.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(calls: DataFrame, group: str, at: str = "ts", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by group and tumbling window, final when the watermark passes."""
    w = calls.withWatermark(at, late).groupBy(F.window(at, size), group).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), group, "n", "total")


def run_windows(calls: DataFrame, group: str, at: str = "ts") -> DataFrame:
    """First and last call and count by group, for complete or update mode: state is a row a group."""
    return calls.groupBy(group).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("calls"))


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into Parquet; a rerun continues after the last batch."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
