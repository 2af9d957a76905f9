"""Joins that plain equality can't say: nearest in time, within a window, nearest vectors, graph steps, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import pairs


def within_window(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows with equal keys and at most `seconds` between their times: an equi-join on time buckets as wide as the
    window, each left row looking into its own and both neighbouring buckets, then the exact condition. Column names of
    the two sides must differ, but for the keys."""
    keys = keys or []
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_bucket", F.explode(F.array(*[bucket(left_ts) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_bucket", bucket(right_ts))
    near = F.abs(F.unix_micros(F.col(left_ts).cast("timestamp")) - F.unix_micros(F.col(right_ts).cast("timestamp"))) <= seconds * 1_000_000
    return a.join(b, ["_bucket", *keys]).where(near).drop("_bucket")


def top_k(candidates: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a partition before the shuffle."""
    return candidates.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


#: Queries of a stated set that meet a block of points at once.
QUERIES_AT_ONCE = 2048


def each_with_each(queries: DataFrame, points: DataFrame, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """Every row of a stated set of queries with every row of points, in blocks: points are dealt to as many blocks as there
    are shuffle partitions, which grow with the data, and queries to parts of about `at_once`; each part meets each block
    in an equi-join, so neither side has to fit in one place and points are sent once for all of a part's queries. Counts
    the queries while the plan is built."""
    blocks = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = max(1, -(-queries.count() // at_once))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("_part", F.pmod(F.xxhash64(*queries.columns), F.lit(parts)).cast("int")).withColumn("_block", every(blocks))
    dealt = points.withColumn("_block", F.pmod(F.xxhash64(*points.columns), F.lit(blocks)).cast("int")).withColumn("_part", every(parts))
    return asked.join(dealt, ["_part", "_block"]).drop("_part", "_block")


def nearest_vectors(points: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """qid, id, cosine, rank: exact. Queries meet the points in blocks, and the first k of each query are kept within
    a block before anything is shuffled."""
    return pairs.nearest(pairs.asked(queries, id_, embedding), pairs.points(points, id_, embedding), k)


def neighbours(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, w) in both directions."""
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


HOP_WEIGHTS = (0.7, 0.5)


def two_hops(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, activation: the best of what one and two weighted steps from the seeds (node) bring; seeds are left out."""
    both = neighbours(edges)
    one = both.join(seeds.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("w") * HOP_WEIGHTS[0]).alias("activation"))
    two = both.join(one.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("activation") * F.col("w") * HOP_WEIGHTS[1]).alias("activation"))
    return one.unionByName(two).join(seeds, "node", "left_anti").groupBy("node").agg(F.max("activation").alias("activation"))


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c with all three edges (a, b, w with a < b), and their mean weight."""
    e = edges.select("a", "b", "w")
    ab, bc, ac = (e.toDF(x, y, f"w_{x}{y}") for x, y in (("a", "b"), ("b", "c"), ("a", "c")))
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c", ((F.col("w_ab") + F.col("w_bc") + F.col("w_ac")) / 3).alias("strength"))


def trace(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, hops: all that can be reached from start (node) over edges (child, parent) in at most `depth` steps, with the
    fewest steps. Each step is written, so that the plan doesn't hold the steps before it many times over."""
    from palimpsest.operators.graph import cut

    seen = front = cut(start.select("node", F.lit(0).alias("hops")))
    for k in range(1, depth + 1):
        front = cut(front.join(edges, F.col("node") == F.col("child")).select(F.col("parent").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
    return seen
