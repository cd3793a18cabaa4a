"""Event-time windows that run on a batch or, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    """On a stream, how long late events are waited for; watermarks ask for instants."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events and their total by window and type; ``late`` is how long a stream waits."""
    rows = _marked(events, late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events without a gap longer than ``gap``."""
    rows = _marked(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "events")
