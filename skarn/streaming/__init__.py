"""Structured Streaming over event tables: an extension, since the dialect itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time_col: str, key_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key. On a stream, rows later than ``late`` are dropped and state is bounded by
    it; on a table all rows count."""
    timed = events.withColumn("event_time", F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark("event_time", late) if events.isStreaming else timed
    counted = timed.groupBy(F.window("event_time", window).alias("w"), F.col(key_col)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key_col, "n")
