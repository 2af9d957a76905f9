"""Tables as immutable snapshots: a change is a new snapshot, computed from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def upsert(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch's rows replace those of the same key. The batch has one row a key."""
    return base.join(batch.select(key), key, "left_anti").unionByName(batch)


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of `changes` that aren't null replace those of the row with the same key; no row is added."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    joined = base.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns])


def delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def append_new(base: DataFrame, batch: DataFrame, content_hash: str, order: list[Column]) -> DataFrame:
    """Rows of the batch whose content is new, the first of each content."""
    return latest(batch, [content_hash], order).join(base.select(content_hash), content_hash, "left_anti")


def index_changes(base: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """(key, action): add, update, keep or remove, by comparing versions of both sides."""
    old = base.select(key, F.col(version).alias("_old"), F.lit(True).alias("_was"))
    new = batch.select(key, F.col(version).alias("_new"), F.lit(True).alias("_is"))
    action = F.when(F.col("_was").isNull(), "add").when(F.col("_is").isNull(), "remove").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return old.join(new, key, "full").select(key, action.alias("action"))
