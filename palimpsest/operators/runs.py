"""Stored runs of an evaluation, and a gate that holds a run against the one before.

A folder holds one table of runs: track, total, content, source (both in per cent), written_at. The newest row of a track is
its baseline. Rows are appended, never changed, so a job that is killed and run again leaves the same baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import joins
from palimpsest.operators.graph import cut

C = F.col
SCHEMA = "track string, total long, content double, source double, written_at timestamp"


def report(cases: DataFrame) -> DataFrame:
    """cases (track, content, source: whether a case hit) -> track, total, content, source in per cent; null is no hit."""
    share = lambda c: F.round(100 * F.avg(F.coalesce(C(c), F.lit(False)).cast("int")), 4)
    return cases.groupBy("track").agg(F.count("*").alias("total"), share("content").alias("content"), share("source").alias("source"))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of a folder; none if nothing has been written there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(SCHEMA).parquet(folder) if there else spark.createDataFrame([], SCHEMA)


def baseline(runs: DataFrame) -> DataFrame:
    """The newest run of each track; of one written twice, one row."""
    return joins.top_k(runs, ["track"], [F.desc("written_at"), C("total"), C("content"), C("source")], 1).drop("rank")


def gate(current: DataFrame, before: DataFrame, now: Column, content: float = 5.0, source: float = 10.0, least_source: float = 0.0, only_below: float = 0.0, days: int = 14) -> DataFrame:
    """track, delta_content, delta_source, verdict. `first`: there is no baseline; `resized`: it has another number of cases;
    `failed`: content fell by more than `content` points (and is under `only_below`, where one is set), or source by more
    than `source`, or source is under `least_source`; `aged`: passed, and the baseline is over `days` old; else `passed`.
    Tracks that only the baseline has are not told."""
    b = before.select("track", C("total").alias("_n"), C("content").alias("_c"), C("source").alias("_s"), "written_at")
    j = current.join(b, "track", "left")
    fell = (C("content") - C("_c") < -content) & (F.lit(only_below == 0.0) | (C("content") < only_below))
    failed = fell | ((C("_s") > 0) & (C("source") - C("_s") < -source)) | F.lit(least_source > 0) & (C("source") < least_source)
    aged = (F.floor((F.unix_micros(now) - F.unix_micros("written_at")) / 86_400_000_000) > days) & (C("_c") - C("content") <= content)
    verdict = F.when(C("_n").isNull(), "first").when(C("_n") != C("total"), "resized").when(failed, "failed").when(aged, "aged").otherwise("passed")
    delta = lambda a, z: F.round(C(a) - C(z), 4).alias(f"delta_{a}")
    return j.select("track", delta("content", "_c"), delta("source", "_s"), verdict.alias("verdict"))


def settle(current: DataFrame, folder: str, now: Column, **limits) -> DataFrame:
    """The gate's verdicts on a run, after which those of its tracks that are first, resized or aged are the baseline."""
    spark = current.sparkSession
    judged = cut(gate(current, baseline(stored(spark, folder)), now, **limits))
    new = current.join(judged.where("verdict IN ('first', 'resized', 'aged')").select("track"), "track", "left_semi")
    new.select("track", C("total").cast("long").alias("total"), "content", "source", now.cast("timestamp").alias("written_at")).write.mode("append").parquet(folder)
    return judged
