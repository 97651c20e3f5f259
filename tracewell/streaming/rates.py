"""Streaming form of binned rates: tumbling event-time windows with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", pop: str = "event_type") -> DataFrame:
    """``pop, t_start, n`` per window; for batch and streaming tables alike. Windows without events have no row."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", late)
    return rows.groupBy(F.window("_t", window), F.col(pop).alias("pop")).agg(F.count(F.lit(1)).alias("n")).select("pop", F.col("window.start").alias("t_start"), "n")
