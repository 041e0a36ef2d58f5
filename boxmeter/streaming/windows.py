"""Event-time windows over streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Times without zone do not carry watermarks, so they become UTC moments."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str, late: str = "1 hour", column: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, keys, n, total per window; rows later than ``late`` behind the newest are dropped by a stream."""
    timed = with_event_time(events, column).withWatermark(column, late)
    out = timed.groupBy(F.window(column, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", column: str = "ts", key: str = "user_id") -> DataFrame:
    """key, start, end, n: stretches of events with pauses below ``gap``."""
    timed = with_event_time(events, column).withWatermark(column, late)
    out = timed.groupBy(F.session_window(column, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
