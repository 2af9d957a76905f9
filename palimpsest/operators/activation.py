"""Spreading activation for many questions at once: personalised PageRank by forward push.

The state is a row a (question, node) that something has reached: what has settled there, and what is left to push. Each
round, all rows with more than the threshold left push together: 1 - damping of it settles, the rest goes to the
neighbours by weight. So a question costs what its own surroundings hold, and no vector over all nodes is kept. What
stays unpushed is under the threshold a node, which bounds how far the result is from the fixed point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import cut, projection

DAMPING, THRESHOLD, ROUNDS = 0.85, 1e-4, 60
#: Rounds between two looks at what is left.
EVERY = 4


def shares(edges: DataFrame) -> DataFrame:
    """src, dst, p: what part of a node's activation goes to each neighbour."""
    e = projection(edges)
    return e.join(e.groupBy("src").agg(F.sum("w").alias("_all")), "src").select("src", "dst", (F.col("w") / F.col("_all")).alias("p"))


def pushed(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """edges (src, dst, w), seeds (question, node) -> question, node, settled, left. Seeds of a question start alike. What a
    seed without edges can't pass on goes back to its question's seeds: that is the same as losing it and making the rest
    greater by 1 / (1 - damping * the part of such seeds), so it costs no round. Runs jobs while the plan is built."""
    c = F.col
    share = shares(edges)
    every = share.select(c("src").alias("node")).unionByName(seeds.select("node")).distinct()
    share = cut(share.unionByName(every.select(c("node").alias("src"), c("node").alias("dst"), F.lit(0.0).alias("p"))))  # a loop keeps what a node has
    seeds = seeds.select("question", "node").distinct().join(share.where("src <> dst").select(c("src").alias("node"), F.lit(0.0).alias("alone")).distinct(), "node", "left").na.fill(1.0, ["alone"])
    of = seeds.groupBy("question").agg((1.0 / F.count("*")).alias("s"), (1.0 / (1.0 - damping * F.avg("alone"))).alias("scale"))
    seeds = cut(seeds.join(of, "question"))
    state = seeds.select("question", "node", F.lit(0.0).alias("settled"), c("s").alias("left"))
    over, own = c("left") > threshold, c("src") == c("dst")
    settled = F.when(own, c("settled") + F.when(over, (1 - damping) * c("left")).otherwise(0.0)).otherwise(0.0)
    left = F.when(own, F.when(over, 0.0).otherwise(c("left"))).otherwise(damping * c("left") * c("p"))
    done = 0
    while done < rounds:
        for _ in range(min(EVERY, rounds - done)):
            sent = state.join(share, (c("node") == c("src")) & (over | own)).select("question", c("dst").alias("node"), settled.alias("settled"), left.alias("left"))
            state = sent.groupBy("question", "node").agg(F.sum("settled").alias("settled"), F.sum("left").alias("left"))
            done += 1
        state = cut(state)
        if not state.where(c("left") > threshold).limit(1).count():
            break
    scale = seeds.groupBy("question").agg(F.max("scale").alias("scale"))
    return state.join(scale, "question").select("question", "node", (c("settled") * c("scale")).alias("settled"), (c("left") * c("scale")).alias("left"))


def activations(edges: DataFrame, seeds: DataFrame, **how) -> DataFrame:
    """question, node, activation: of nodes that aren't seeds, the greatest of a question made 1."""
    state = pushed(edges, seeds, **how).where("settled > 0").join(seeds.select("question", "node"), ["question", "node"], "left_anti")
    most = state.groupBy("question").agg(F.max("settled").alias("most"))
    return state.join(most, "question").select("question", "node", (F.col("settled") / F.col("most")).alias("activation"))


#: What activation adds at most, to how many results, and how near the third result's score must be to the first's.
BONUS, FIRST, NEAR = 5.0, 10, 0.90


def gated_bonus(results: DataFrame, named: DataFrame, active: DataFrame) -> DataFrame:
    """results (question, id, score, rank), named (id, node), active (question, node, activation) -> question, id, score:
    the greatest activation among a result's nodes adds up to BONUS, to the first FIRST results, where scores are too near
    one another to tell: the third is at least NEAR of the first."""
    c = F.col
    at = lambda k: F.max(F.when(c("rank") == k, c("score")))
    close = results.where("rank <= 3").groupBy("question").agg(F.coalesce(at(3) >= NEAR * at(1), F.lit(False)).alias("close"))
    warm = results.where(c("rank") <= FIRST).select("question", "id").join(named, "id").join(active, ["question", "node"]).groupBy("question", "id").agg(F.max("activation").alias("warm"))
    bonus = F.when(c("close"), BONUS * F.coalesce("warm", F.lit(0.0))).otherwise(0.0)
    return results.join(close, "question").join(warm, ["question", "id"], "left").select("question", "id", (c("score") + bonus).alias("score"))
