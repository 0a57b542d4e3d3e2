"""Streams of events and incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, for a stream or a table."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    rows = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    rows = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def file_batches(spark, path: str, schema: str, files: int = 10) -> DataFrame:
    """JSON lines of a folder as a stream of at most ``files`` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def resume(source: DataFrame, done_path: str, keys: list[str], work: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Work through a file stream in batches, skipping keys that are done, and append results; starting again repeats nothing."""
    from ravelin.sources.sinks import append_new

    return source.writeStream.foreachBatch(lambda df, _: append_new(work(df), done_path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
