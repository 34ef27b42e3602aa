"""Event-time windows over the events stream, with a watermark for late rows (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """``start, event_type, n, total`` of tumbling or sliding windows; the same plan for a stream and a table.

    A stream keeps state only for windows the watermark has not passed.
    """
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", late) if events.isStreaming else d
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return d.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``user_id, start, end, n`` of each user's sessions."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", gap) if events.isStreaming else d
    return d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
