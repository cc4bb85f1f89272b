"""Streams of events or stage records: windows with watermarks, sessions, running state. Beyond what a batch run needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events with a zoned time and a watermark on it; rows more than late behind the latest are dropped by state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and kind."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = timed(events).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user: start, end, number of events."""
    found = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
