"""Fusion of ranked lists, and the sequential choices made on a query's few results.

Each sequential operator works on one query's list, which earlier top-k steps have bounded, as one group of
applyInPandas; lists of different queries run apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """lists (qid, id, source, rank from 0) -> (qid, id, score from 0 to 100): the sum of weight / (k + rank), over what a
    row that leads all of the query's non-empty lists would get. Sources without a weight have 1."""
    weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(w)) for s, w in weights.items()], F.lit(1.0))
    return weighed(lists.withColumn("weight", weight), k)


def weighed(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """As `rrf`, with a weight in each row (qid, id, source, rank, weight): a source may weigh more for one query than for
    another."""
    lists = lists.withColumnRenamed("weight", "_w")
    most = lists.groupBy("qid", "source").agg(F.max("_w").alias("_w")).groupBy("qid").agg((F.sum("_w") / k).alias("_most"))
    scores = lists.groupBy("qid", "id").agg(F.sum(F.col("_w") / (k + F.col("rank"))).alias("_s"))
    return scores.join(most, "qid").select("qid", "id", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.col("_s") / F.col("_most"))).alias("score"))


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def greedy_dedup(candidates: DataFrame, most: float, window: int) -> DataFrame:
    """candidates (qid, id, score, tokens) -> those that are kept, best first: a row goes if one of the last `window` kept
    rows has a Jaccard over `most`; sizes that differ by more than half can't."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        kept: list[frozenset] = []
        keep = []
        for tokens in rows["tokens"]:
            own = frozenset(tokens)
            near = any(min(len(own), len(k)) >= 0.5 * max(len(own), len(k)) and _jaccard(own, k) > most for k in kept[-window:])
            keep.append(not near)
            if not near:
                kept.append(own)
        return rows.loc[keep, ["qid", "id", "score"]]

    schema = candidates.select("qid", "id", "score").schema
    return candidates.groupBy("qid").applyInPandas(choose, schema)


def mmr(candidates: DataFrame, limit: int, weight: float = 0.85, least_gain: float = 0.02) -> DataFrame:
    """candidates (qid, id, score, tokens) -> (qid, id, rank): relevance less likeness to what is chosen, up to 2 * limit
    picks; it ends early once the best value falls by less than `least_gain`; the rest follow in their order."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        sets, top = [frozenset(x) for x in rows["tokens"]], max(float(rows["score"].max()), 1e-9)
        relevance = (rows["score"] / top).tolist()
        chosen, left, before = [0], list(range(1, len(rows))), None
        while left and len(chosen) < 2 * limit:
            value, best = max((weight * relevance[k] - (1 - weight) * max(_jaccard(sets[k], sets[c]) for c in chosen), -k) for k in left)
            if before is not None and before - value < least_gain and len(chosen) >= limit:
                break
            chosen.append(-best)
            left.remove(-best)
            before = value
        order = chosen + left
        return pd.DataFrame({"qid": rows["qid"].iloc[0], "id": rows["id"].iloc[order].tolist(), "rank": range(1, len(order) + 1)})

    kinds = candidates.select("qid", "id").schema
    return candidates.groupBy("qid").applyInPandas(choose, f"qid {kinds['qid'].dataType.simpleString()}, id {kinds['id'].dataType.simpleString()}, rank int")


def budget(blocks: DataFrame, limit: int) -> DataFrame:
    """blocks (qid, id, priority, score, tokens) -> those that fit: by priority, then score; one that is too large is
    passed over, and smaller ones after it may still fit."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["priority", "score", "id"], ascending=[True, False, True])
        left, keep = limit, []
        for n in rows["tokens"]:
            keep.append(n <= left)
            left -= n if n <= left else 0
        return rows.loc[keep, ["qid", "id", "tokens"]]

    return blocks.groupBy("qid").applyInPandas(choose, blocks.select("qid", "id", "tokens").schema)
