"""The same windows over a stream as over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling(events: DataFrame, length: str = "30 minutes", slide: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Counts, errors and mean latency of each route by sliding window. `late` sets a watermark, for streams."""
    if late:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", length, slide), "route").agg(F.count("*").alias("n"), F.sum("error").alias("errors"), F.avg("latency").alias("latency"))
    return g.select(F.col("window.start").alias("start"), "route", "n", "errors", "latency")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.session_window("ts", gap), "session").agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), "session", "n")


def first_sightings(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key; with a watermark, keys are forgotten after it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
