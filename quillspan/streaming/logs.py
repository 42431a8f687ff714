"""Structured Streaming forms of the event log, its tail, sessions and windows; stateful ones are in ``relay``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_log(events: DataFrame, key: list[str], time: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Each (key) delivered once, however often it arrives within the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def tail(log: DataFrame, since: int, seq: str = "seq") -> DataFrame:
    """Entries after a resume point; the stream's checkpoint holds it between runs."""
    return log.where(F.col(seq) > since)


def attach_runs(events: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Events of known runs only: a stream-static inner join."""
    return events.join(runs, key)


def sessions(events: DataFrame, key: str, gap: str, time: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Session windows by inactivity gap, with counts and totals."""
    w = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), key)
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")


def windows(events: DataFrame, size: str, slide: str | None = None, time: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling, or with ``slide`` sliding, counts and totals by event type."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = events.withWatermark(time, lateness).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "events", "total")
