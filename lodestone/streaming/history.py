"""Counts and sessions over streams of events, bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress(events: DataFrame, at: str, kind: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, kind, n): events of each kind by window; events later than ``late`` are left out."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, window), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select("window.start", "window.end", "kind", "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events of a key that follow one another within ``gap``."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.select("key", "session_window.start", "session_window.end", "n")
