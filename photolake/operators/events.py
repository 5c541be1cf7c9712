"""Counts over time windows and sessions of an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, *by: str) -> DataFrame:
    """Number and sum of events by tumbling window; works on tables and, with a watermark, on streams."""
    found = events.groupBy(F.window("ts", length).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str) -> DataFrame:
    """Runs of a key's events with pauses shorter than ``gap``: begin, last event and number."""
    found = events.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return found.select(by, F.col("w.start").alias("start"), "last", "n")
