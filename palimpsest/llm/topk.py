"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks, and every block of queries meets every block of vectors once, in a task of bounded size.
There, each dimension has a list of the vectors sorted by that component, and a query reads each list from the end that
its own component favours. At every step, the lists whose next entry adds most to the query's product are read on, down
to a common level of what an entry adds; so lists are read in proportion to the query's components. Every vector come
across is scored. No vector not yet seen can score more than the sum of what the lists' next entries add; once the k-th
best score is above that bound, the answer for the block is final. The level falls by half a step, and at last to the
lists' ends; there is no other way to an answer.

Blocks are met in waves of 1, 3, 12, 48, ... blocks: the k-th score of the waves before is known to the next one, so that
a query leaves a block as soon as nothing in it can reach the best k of all.

Components are compared as floor(scale * x) in whole numbers; products are summed exactly (in floats while every partial
sum is below 2^53, in 64-bit integers below 2^62, in Python integers beyond). Scores outside of 64 bits are given, and
ranked, as the nearest 64-bit integer.

Nulls and odd cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows
without an id; vectors meet queries of the same number of components only; repeated rows are candidates and queries of
their own, but no row with a query's id is its candidate; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import staged

K = 20
SCALE = 64
QUERY_EVERY = 20
VECTORS_AT_ONCE = 16384
QUERIES_AT_ONCE = 2048
#: Queries whose reading goes on side by side; bounds the marks of what they have seen.
SIDE_BY_SIDE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def wholes(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers, or as Python integers where those may not hold it."""
    if float(np.abs(x).max(initial=0.0)) < (1 << 61) / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = [math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def products(queries: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Exact integer inner products, queries x vectors; no partial sum is beyond `most`."""
    if most < 1 << 53:
        return np.asarray(queries, dtype=float) @ np.asarray(vectors, dtype=float).T
    return np.dot(queries, vectors.T)


class Lists:
    """A block's vectors, sorted by id, and for each dimension their order by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.vectors, self.lists.T, axis=0).T)

    def depths(self, queries: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """queries x dimensions: how many entries of each list add more than the query's level."""
        out = np.zeros(queries.shape, dtype=np.int64)
        for i, components in enumerate(self.sorted):
            up, down = queries[:, i] > 0, queries[:, i] < 0
            out[up, i] = len(self.ids) - np.searchsorted(components, levels[up] // queries[up, i], side="right")
            out[down, i] = np.searchsorted(components, -(-levels[down] // queries[down, i]), side="left")
        return out

    def bounds(self, queries: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """What a vector not seen at these depths can score at most, where no list is at its end."""
        n, total = len(self.ids), 0
        for i, components in enumerate(self.sorted):
            at = np.where(queries[:, i] > 0, n - 1 - depths[:, i], depths[:, i])
            total = total + queries[:, i] * components[np.clip(at, 0, n - 1)]
        return total

    def best(self, of: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the rows `of`, without the query's own: rows and scores, best first, ties by id."""
        keep = self.ids[of] != own
        of, scores = of[keep], scores[keep]
        if len(of) > k and scores.dtype != object:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            of, scores = of[scores >= least], scores[scores >= least]
        first = np.lexsort((of, np.negative(scores)))[:k] if scores.dtype != object else np.array(sorted(range(len(of)), key=lambda j: (-scores[j], of[j]))[:k], dtype=int)
        return of[first], scores[first]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
        """(place of the query, rows, scores, list entries read, vectors scored) of each query.

        floors: for each query a score that its k best of other blocks reach, LEAST where none is known.
        """
        n, d = self.vectors.shape
        for low in range(0, len(queries), SIDE_BY_SIDE):
            some = queries[low : low + SIDE_BY_SIDE]
            most = int(np.abs(some).max(initial=0)) * int(np.abs(self.vectors).max(initial=0)) * max(1, d)
            exact = some.dtype if most < 1 << 62 else object
            vectors, asked = self.vectors.astype(exact, copy=False), some.astype(exact, copy=False)
            held = np.asarray(vectors, dtype=np.float32 if most < 1 << 24 else float) if most < 1 << 53 else vectors
            floor = [LEAST if floors is None else int(f) for f in (floors[low : low + len(some)] if floors is not None else some)]
            nothing = np.zeros(0, dtype=np.int64)
            rows, scores = [nothing] * len(some), [nothing] * len(some)
            seen, before = np.zeros((len(some), n), dtype=bool), np.zeros((len(some), d), dtype=np.int64)
            levels = np.maximum(self.bounds_of_heads(asked), 1)
            open_ = list(range(len(some)))
            while open_:
                levels = np.array([x // 2 for x in levels.tolist()], dtype=levels.dtype)
                last = all(levels[q] == 0 for q in open_)
                depths = self.depths(asked[open_], levels[open_])
                if last:  # to the lists' ends
                    depths[:, 0] = n
                bounds = self.bounds(asked[open_], depths)
                left = []
                for q, depth, bound in zip(open_, depths, bounds.tolist(), strict=True):
                    marks = np.zeros(n, dtype=bool)
                    for i in np.flatnonzero(depth > before[q]).tolist():
                        a, b = int(before[q, i]), int(depth[i])
                        marks[self.lists[i, n - b : n - a] if asked[q, i] > 0 else self.lists[i, a:b]] = True
                    before[q] = np.maximum(before[q], depth)
                    new = np.flatnonzero(marks & ~seen[q])
                    seen[q] |= marks
                    if len(new):
                        if 2 * len(new) > n:
                            found = products(asked[q].astype(held.dtype), held, most)[new]
                        else:
                            found = products(asked[q].astype(held.dtype), held[new], most)
                        found = np.array([min(MOST, max(LEAST, int(s))) for s in found.tolist()], dtype=np.int64) if exact is object else found.astype(np.int64)
                        rows[q], scores[q] = self.best(np.concatenate([rows[q], new]), np.concatenate([scores[q], found]), int(query_ids[low + q]), k)
                    reached = max(floor[q], int(scores[q][-1]) if len(rows[q]) == k else LEAST)
                    if reached > max(bound, LEAST) or (depth == n).any() or seen[q].all():
                        yield low + q, rows[q], scores[q], int(before[q].sum()), int(seen[q].sum())
                    else:
                        left.append(q)
                open_ = left

    def bounds_of_heads(self, queries: np.ndarray) -> np.ndarray:
        """The most that any one entry adds to each query."""
        most = np.maximum(queries * self.sorted[:, -1], queries * self.sorted[:, 0])
        return most.max(axis=1)


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, x: the vectors that take part, as doubles."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    good = F.col(vec_id).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))


def waves(blocks: int) -> Iterator[tuple[int, int]]:
    """Stretches of 1, 3, 12, 48, ... blocks: each wave quadruples what has been met."""
    low, high = 0, 1
    while low < blocks:
        yield low, min(high, blocks)
        low, high = high, high * 4


def search(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, vectors_at_once: int = VECTORS_AT_ONCE, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k best rows of vectors."""
    held = staged(whole_vectors(vectors, vec_id, embedding), "topk-vectors")
    asked = staged(whole_vectors(queries, vec_id, embedding), "topk-queries")
    blocks = max(1, -(-held.count() // vectors_at_once))
    groups = max(1, -(-asked.count() // queries_at_once))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("int")
    every = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
    size = F.size("x").alias("dimensions")
    left = held.select("vec_id", "x", size, deal(blocks).alias("block"))
    again = F.row_number().over(Window.partitionBy("vec_id", "x").orderBy("vec_id"))
    right = asked.withColumn("row", F.xxhash64("x", again)).select("vec_id", "x", "row", size, deal(groups).alias("group"))
    right = staged(right, "topk-asked") if blocks > 1 else right

    def meet(own: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(of):
            lists = Lists(own["vec_id"].to_numpy(), wholes(np.stack(own["x"].to_list()), scale))
            ids, places = of["vec_id"].to_numpy(), of["row"].to_numpy()
            for q, found, scores, _, _ in lists.search(ids, wholes(np.stack(of["x"].to_list()), scale), k, of["floor"].to_numpy()):
                rows.append(pd.DataFrame({"query_id": ids[q], "row": places[q], "vec_id": lists.ids[found], "score": scores}))
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []}, dtype="int64")

    keys = ["block", "group", "dimensions"]
    place = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    best = None
    for low, high in waves(blocks):
        floors = right.withColumn("floor", F.lit(LEAST))
        if best is not None:
            known = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "row", F.col("score").alias("floor"))
            floors = right.join(known, ["vec_id", "row"], "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST)))
        met = left.where(f"block >= {low} and block < {high}").withColumn("group", every(0, groups))
        found = met.groupBy(*keys).cogroup(floors.withColumn("block", every(low, high)).groupBy(*keys)).applyInPandas(meet, "query_id long, row long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = found.withColumn("rank", place).where(F.col("rank") <= k)
        best = staged(best, "topk-best") if high < blocks else best
    return best.select("query_id", "rank", "vec_id", "score")
