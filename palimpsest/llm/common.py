"""What the training-data operators share: words, staging and joins that hold up under hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. bytes.split() cuts at the same seven characters less none.
WORD = r"[^\x20\x09-\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local session (tests) gets a
    new temporary one; on a cluster that is an error, for no executor could read what another one wrote."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: what was computed once is not computed again, and losing an
    executor costs only the tasks in flight."""
    spark = session_of(df)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a Python worker's free memory to the system at the end of a task: workers idle on beside the next stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def shuffle_parts(spark: SparkSession) -> int:
    """The cluster's partition count, which its owner sizes by the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def power_of_two(n: int) -> int:
    """The exponent of the first power of two that is n or more."""
    return max(1, (max(1, n) - 1).bit_length())


def hash_bucket(h: Column, bits: int) -> Column:
    """The top bits of a 64-bit hash: buckets that keep the hash's unsigned order."""
    return F.shiftrightunsigned(h, 64 - bits)


#: A key with at least this share of all rows is hot; so at most 1 / HOT_SHARE keys are, which bounds what is broadcast.
HOT_SHARE = 0.002
SALTS = 64


def hot_safe_join(left: DataFrame, right: DataFrame, key: str, rows: str, spread: Column, total: int) -> DataFrame:
    """left join right on key, where right has one row a key and tells in column `rows` how many rows of left have it.

    Keys with HOT_SHARE of the rows (at most 500, by arithmetic, so their list is safe to broadcast) are spread over
    SALTS parts by `spread`; all others join as they are. Null keys match nothing and stay, with nulls.
    """
    least = max(64, int(total * HOT_SHARE))
    hot = right.where(F.col(rows) >= least).select(F.col(key), F.lit(True).alias("_hot"))
    salted = right.withColumn(
        "_salt", F.explode(F.when(F.col(rows) >= least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop(rows)
    marked = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    )
    return marked.drop("_hot").join(salted, [key, "_salt"], "left").drop("_salt")
