"""Extras beyond the surveyed operators: windowed counts, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events per type and hour. On a stream, `watermark` bounds the state and lets late rows in until then."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # also times without a zone
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Sessions per user: events with less than `gap` between them."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # also times without a zone
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("w.start").alias("began"), "n_events")
