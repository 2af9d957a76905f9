"""Graphs as edge tables (src, dst, w): projection, forgetting, merging, activation, communities."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that the cluster's executors share; in local mode a temporary one is set where there is none."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so that plans of loops stay short."""
    spark = df.sparkSession
    path = f"{shared(spark)}/graph-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def projection(edges: DataFrame) -> DataFrame:
    """Both directions, the greatest weight of parallel edges, no loops."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))


def lasting(w: Column, n: Column) -> Column:
    return (n >= 5) & (w >= 0.3)


def forgotten(w: Column, n: Column, idle_days: Column) -> Column:
    """Weight after a time without use; what is lasting, or hardly idle, keeps it."""
    stability = F.when(n < 2, 20.0).when(n < 5, 45.0).when(n < 10, 90.0).otherwise(180.0)
    retention = F.exp(-idle_days / stability)
    return F.when(lasting(w, n) | (retention >= 0.99), w).otherwise(w * retention)


def reinforced(w: Column, n: Column, rate: Column | float) -> Column:
    """n steps of w += rate * (1 - w), in closed form."""
    return 1 - (1 - w) * F.pow(F.lit(1.0) - rate, n)


def merged(edges: DataFrame, aliases: dict[int, int]) -> DataFrame:
    """Aliases' edges become their canonical node's; parallel ones add up to 1 at most."""
    src = F.coalesce(*[F.when(F.col("src") == a, F.lit(c)) for a, c in aliases.items()], F.col("src"))
    return edges.select(src.cast("long").alias("src"), "dst", "w").groupBy("src", "dst").agg(F.least(F.lit(1.0), F.sum("w")).alias("w"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-4, every: int = 1) -> DataFrame:
    """node, activation: personalised PageRank from the seeds (node) over the projection, the seeds left out, the greatest
    made 1. A node without edges gives its rank back to the seeds. Runs jobs while the plan is built: after every few
    rounds, ranks are written and looked at."""
    e = cut(projection(edges))
    share = e.join(e.groupBy("src").agg(F.sum("w").alias("_all")), "src").select("src", "dst", (F.col("w") / F.col("_all")).alias("p"))
    share = cut(share)
    nodes = e.select(F.col("src").alias("node")).unionByName(seeds.select("node")).distinct()
    count = seeds.distinct().count()
    start = nodes.join(seeds.distinct().withColumn("s", F.lit(1.0 / max(1, count))), "node", "left").na.fill(0.0, ["s"])
    ranks = cut(start.withColumn("r", F.col("s")).withColumn("before", F.col("s")))
    done = 0
    while done < rounds:
        for _ in range(min(every, rounds - done)):
            given = share.join(ranks.select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("p")).alias("g"))
            held = ranks.select("node", "s", "r").join(given, "node", "left").na.fill(0.0, ["g"])
            lost = held.agg((1.0 - F.coalesce(F.sum("g"), F.lit(0.0))).alias("lost"))  # one row
            ranks = held.join(F.broadcast(lost)).select("node", "s", (damping * (F.col("g") + F.col("lost") * F.col("s")) + (1 - damping) * F.col("s")).alias("r"), F.col("r").alias("before"))
            done += 1
        ranks = cut(ranks)
        if (ranks.agg(F.sum(F.abs(F.col("r") - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    others = ranks.join(seeds, "node", "left_anti")
    most = others.agg(F.max("r").alias("most"))
    return others.where("r > 0").join(F.broadcast(most)).select("node", (F.col("r") / F.col("most")).alias("activation"))


def components(edges: DataFrame) -> DataFrame:
    """edges (src, dst) -> node, component (its least node). Each round a component takes the least one next to it, and
    chains of such steps are followed to their ends, in steps that double. Runs jobs while the plan is built."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("next")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("next").alias("next"))
        to = labels.join(seen, "node").groupBy("component").agg(F.min("next").alias("next")).select("component", F.least("component", "next").alias("next"))
        to = cut(to)
        if to.where("next < component").isEmpty():
            return labels
        while True:
            further = to.join(to.select(F.col("component").alias("next"), F.col("next").alias("then")), "next").select("component", "next", "then")
            further = cut(further)
            to = further.select("component", F.col("then").alias("next"))
            if further.where("then < next").isEmpty():
                break
        labels = cut(labels.join(to, "component").select("node", F.col("next").alias("component")))


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """node, community: each round a node takes the label with most weight around it, ties to the smaller label. Its own
    label counts as much as its strongest edge, so that two nodes don't swap labels for ever."""
    e = projection(edges)
    e = cut(e.unionByName(e.groupBy("src").agg(F.max("w").alias("w")).select("src", F.col("src").alias("dst"), "w")))
    labels = cut(e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for _ in range(rounds):
        votes = e.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.round(F.sum("w"), 9).alias("votes"))
        best = votes.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("votes"), "community"))).where("k = 1")
        new = cut(best.select(F.col("src").alias("node"), "community"))
        changed = new.join(labels.withColumnRenamed("community", "before"), "node").where("community <> before").limit(1).count()
        labels = new
        if not changed:
            break
    return labels


def capped_clusters(edges: DataFrame, most: int) -> DataFrame:
    """node, cluster (its least node): strongest edges first, ties to smaller ends, two clusters become one unless they
    would have more than `most` nodes. Edges (src, dst, w) lead from one node to another.

    Two clusters whose best edge that still fits is the same one become one at once: edges before it at either end don't
    fit any more, as clusters only grow, so taking edges one by one comes to the same. Each round settles all such pairs.
    Runs jobs while the plan is built."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").where("src <> dst")
    e = e.groupBy("src", "dst").agg(F.max("w").alias("w"))
    e = cut(e)
    left = e.where(F.lit(most) >= 2).select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b"))
    nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("cluster"), F.lit(1).alias("size")))
    while True:
        ends = left.select("src", "dst", F.struct("w", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d")).alias("k"), F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("x"))
        best = ends.groupBy(F.col("x.own").alias("own")).agg(F.max(F.struct("k", F.col("x.other").alias("other"))).alias("m")).select("own", "m.k", "m.other")
        pairs = best.where("own < other").join(best.select(F.col("own").alias("other"), F.col("k").alias("back")), "other").where("k = back")
        pairs = cut(pairs.select(F.col("own").alias("into"), F.col("other").alias("cluster")))
        if not pairs.limit(1).count():
            return nodes.select("node", "cluster")
        moved = nodes.join(pairs, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"))
        nodes = cut(moved.join(moved.groupBy("cluster").agg(F.count("*").cast("int").alias("size")), "cluster").select("node", "cluster", "size"))
        a, b = (nodes.select(F.col("node").alias(n), F.col("cluster").alias(c), F.col("size").alias(f"size_{c}")) for n, c in (("src", "a"), ("dst", "b")))
        left = cut(left.select("src", "dst", "w").join(a, "src").join(b, "dst").where(f"a <> b AND size_a + size_b <= {most}").select("src", "dst", "w", "a", "b"))


def complete_link(points: DataFrame, least: float, most: int) -> DataFrame:
    """points (group, id, embedding) -> (group, id, cluster): in order of ids, a point joins the first cluster all of whose
    members have a cosine of `least` with it and that has room, or starts one. A group is one pass of its own."""
    import numpy as np
    import pandas as pd

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        x = np.stack(rows["embedding"].to_list()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        clusters: list[list[int]] = []
        out = []
        for k in range(len(rows)):
            at = next((c for c, own in enumerate(clusters) if len(own) < most and (x[own] @ x[k] >= least).all()), len(clusters))
            if at == len(clusters):
                clusters.append([])
            clusters[at].append(k)
            out.append(at)
        return pd.DataFrame({"group": rows["group"], "id": rows["id"], "cluster": out})

    kind = points.schema["group"].dataType.simpleString()
    return points.groupBy("group").applyInPandas(choose, f"group {kind}, id long, cluster int")


def summary_tree(points: DataFrame, levels: list[Column]) -> DataFrame:
    """points (id, embedding, ...), a column of nodes for each level -> level (from 1), node, summary (the id of the member
    nearest the members' mean, ties to the smaller), members. Means are taken place by place, so no node is gathered."""
    from palimpsest.functions import vector

    nodes = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.cast("long").alias("node")) for k, c in enumerate(levels, 1)]))
    rows = points.select("id", "embedding", nodes.alias("n")).select("n.level", "n.node", "id", "embedding")
    parts = rows.select("level", "node", F.posexplode("embedding").alias("i", "x")).groupBy("level", "node", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("level", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    near = F.struct(F.round(vector.cosine(F.col("embedding"), F.col("mean")), 5).alias("c"), (-F.col("id")).alias("k"))
    return rows.join(means, ["level", "node"]).groupBy("level", "node").agg(F.max_by("id", near).alias("summary"), F.count("*").alias("members"))


#: Points that spectral clustering takes at most, and how many clusters it looks for.
MOST_SPECTRAL, CLUSTERS = 2000, (2, 12)


def spectral(points: DataFrame) -> DataFrame:
    """points (id, embedding), at most MOST_SPECTRAL of them -> id, cluster (the least id in it). Likeness is the cosine, where
    positive; as many clusters as the greatest gap between eigenvalues of the normalised Laplacian says, found by k-means
    on its first eigenvectors from far-apart rows. More points raise an error: their likeness would fill a task."""
    import numpy as np
    import pandas as pd

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > MOST_SPECTRAL:
            raise ValueError(f"spectral clustering takes {MOST_SPECTRAL} points at most")
        rows = rows.sort_values("id").reset_index(drop=True)
        x = np.stack(rows["embedding"].to_list()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        like = np.maximum(x @ x.T, 0)
        root = 1 / np.sqrt(np.maximum(like.sum(axis=1), 1e-12))
        values, vectors = np.linalg.eigh(np.eye(len(x)) - root[:, None] * like * root)
        low, high = CLUSTERS[0], min(CLUSTERS[1], len(x) - 1)
        k = low + int(np.argmax(np.diff(values)[low - 1 : high])) if high >= low else 1
        u = vectors[:, :k] / np.maximum(np.linalg.norm(vectors[:, :k], axis=1, keepdims=True), 1e-12)
        centre = u[:1]
        while len(centre) < min(k, len(u)):
            far = ((u[:, None] - centre) ** 2).sum(axis=2).min(axis=1)
            centre = np.vstack([centre, u[int(np.argmax(far))]])
        for _ in range(50):
            own = ((u[:, None] - centre) ** 2).sum(axis=2).argmin(axis=1)
            new = np.stack([u[own == c].mean(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
            if np.allclose(new, centre):
                break
            centre = new
        least = rows["id"].groupby(own).min()
        return pd.DataFrame({"id": rows["id"], "cluster": least.loc[own].to_numpy()})

    return points.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(cluster, "id long, cluster long")
