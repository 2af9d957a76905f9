"""Incremental ingestion: a stream whose batches are merged into a table by key, with the mark moved after the write.

A batch's rows are folded to one row a key (the newest) and written as a folder named by the batch's number; then a file
names the batch as the newest whole one. A batch that was cut off between the two is written again under its own name, so
doing it twice changes nothing. A reader takes the newest row of each key among whole batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


class Sink:
    """A folder of batches, and of marks of those that are whole."""

    def __init__(self, folder: str, keys: list[str], version: str):
        self.folder, self.keys, self.version = folder.rstrip("/"), keys, version

    def order(self) -> list[Column]:
        return [F.desc(self.version), F.desc("_batch")]

    def write(self, batch: DataFrame, number: int) -> None:
        own = newest(batch.withColumn("_batch", F.lit(number).cast("long")), self.keys, [*self.order(), *[F.desc(c) for c in batch.columns]])
        own.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")

    def mark(self, spark: SparkSession, number: int) -> None:
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/{number}")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """What foreachBatch calls."""
        self.write(batch, number)
        self.mark(batch.sparkSession, number)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row of each key, of whole batches only."""
        marks = spark.read.option("recursiveFileLookup", True).schema("number long").parquet(f"{self.folder}/marks").distinct()
        rows = spark.read.parquet(f"{self.folder}/rows").drop("batch").join(marks, F.col("_batch") == F.col("number"), "left_semi")
        return newest(rows, self.keys, self.order()).drop("_batch")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint)
