"""Failure rates over a stream of attempts. An extension: the reference semantics are batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_failures(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Attempts, failures and mean duration per tumbling window and type; works on a stream and on a table.

    `events` has ts, event_type and value; events later than the watermark are dropped on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    t = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"), F.avg("value").alias("m"))
    return t.select(F.col("w.start").alias("window_start"), "event_type", "attempts", "failures", F.round("m", 9).alias("mean_value"))
