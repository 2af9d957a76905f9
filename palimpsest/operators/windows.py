"""Sequences: sessions by time gap, percentiles by index, runs, caps, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: int, out: str = "session_no", most: int | None = None) -> DataFrame:
    """Adds a running session number within the keys: a row starts a new session if more than the gap has passed since the
    row before it. With `most`, a session is cut after that many rows."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(at - F.lag(at).over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    found = events.withColumn("_new", new).withColumn(out, F.sum("_new").over(w)).drop("_new")
    if most:
        place = F.row_number().over(Window.partitionBy(*keys, out).orderBy(ts, tie)) - 1
        found = found.withColumn("_part", F.floor(place / most)).withColumn(out, F.dense_rank().over(Window.partitionBy(*keys).orderBy(out, "_part")) - 1).drop("_part")
    return found


def index_percentile(sorted_values: Column, p: float) -> Column:
    """The value at place int(n * p) of n sorted values, the last one at most: not interpolated."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(n - 1, F.floor(n * F.lit(p)).cast("int")))


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str = "island") -> DataFrame:
    """Numbers the runs of equal values within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_changed", changed).withColumn(out, F.sum("_changed").over(w)).drop("_changed")


def capped_last(rows: DataFrame, by: list[str], path: str, order: list[Column], most: int) -> DataFrame:
    """Rank within `by`, where rows of a path beyond its first `most` come after all others."""
    own = F.row_number().over(Window.partitionBy(*by, path).orderBy(*order))
    over = rows.withColumn("_over", own > most)
    return over.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_over", *order))).drop("_over")
