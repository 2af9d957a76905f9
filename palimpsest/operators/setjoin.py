"""Pairs of sets that are much alike, without meeting all pairs: prefix filters over rare tokens.

Tokens are ordered by how few sets have them. A set that shares enough with another one shares at least one of its first
tokens in that order, so only those prefixes meet; the frequent tokens at the end never do. Equal sets are one class, met
once. Candidates are held by size and checked on the whole sets.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIKE = ("jaccard", "containment")


def needed(n: Column, least: float, like: str) -> Column:
    """How many of its n tokens a set shares at least with any partner (containment: with any that is as large)."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(least) - F.lit(1e-9))).cast("int")


def classes(sets: DataFrame, by: list[str]) -> DataFrame:
    """The sets' ids and classes: `of` is the least id of those with equal tokens and keys. sets: (id, tokens, by)."""
    tokens = F.array_sort(F.array_distinct("tokens"))
    held = sets.select("id", *by, tokens.alias("tokens")).where(F.size("tokens") > 0)
    same = F.sha2(F.concat_ws("\u0001", "tokens"), 256)
    held = held.withColumn("same", same)
    least = held.groupBy(*by, "same").agg(F.min("id").alias("of"))
    return held.join(least, [*by, "same"]).drop("same")


def candidates(whole: DataFrame, by: list[str], least: float, like: str) -> DataFrame:
    """a, b: ids of classes that share a token of their prefixes, once a pair. whole: (of, n, tokens, by)."""
    words = whole.select("of", *by, "n", F.explode("tokens").alias("token"))
    rare = words.groupBy(*by, "token").agg(F.count("*").alias("df")).where("df > 1")  # a token of one set joins nothing, but counts
    ranked = words.join(rare, [*by, "token"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    order = ranked.groupBy("of", *by, "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"))
    first = order.select("of", *by, "n", F.explode(F.slice("order", F.lit(1), F.col("n") - needed(F.col("n"), least, like) + 1)).alias("x")).where("x.df > 1")
    left = first.select(*by, F.col("x.token").alias("token"), F.col("of").alias("a"), F.col("n").alias("na"))
    if like == "jaccard":
        right, sizes = left.toDF(*by, "token", "b", "nb"), (F.col("na") * F.lit(least) <= F.col("nb") + 1e-9) & (F.col("nb") * F.lit(least) <= F.col("na") + 1e-9) & (F.col("a") < F.col("b"))
    else:  # the smaller set's prefix meets all tokens of one as large or larger
        right, sizes = words.select(*by, "token", F.col("of").alias("b"), F.col("n").alias("nb")), (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return left.join(right, [*by, "token"]).where(sizes).select("a", "b").distinct()


def alike(sets: DataFrame, least: float, like: str = "jaccard", by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(id, of: membership in classes of equal sets; a, b, likeness: pairs of classes, a < b). sets: (id, tokens) and keys
    that both of a pair must share. Sets without tokens are like nothing."""
    if like not in LIKE or not 0 < least <= 1:
        raise ValueError(f"likeness is one of {LIKE}, at least something and at most 1")
    by_ = list(by)
    members = classes(sets, by_)
    whole = members.where("id = of").withColumn("n", F.size("tokens"))
    pairs = candidates(whole, by_, least, like)
    tokens = whole.select("of", "tokens", "n")
    met = pairs.join(tokens.toDF("a", "ta", "na"), "a").join(tokens.toDF("b", "tb", "nb"), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    of = F.col("na") + F.col("nb") - both if like == "jaccard" else F.least("na", "nb")
    found = met.withColumn("likeness", both / of).where(F.col("likeness") >= least - 1e-12)
    return members.select("id", "of", *by_), found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def pairs_of_ids(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: pairs of ids, copies expanded; for those who want each pair told."""
    of = lambda n: members.select(F.col("of").alias(n), F.col("id").alias(f"id_{n}"))
    between = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    within = members.select(F.col("id").alias("a"), "of").join(members.select(F.col("id").alias("b"), "of"), "of").where("a < b").select("a", "b")
    return between.unionByName(within)


#: Rows of a key that a task reads in order at once.
STRETCH = 2000


def like_recent(sets: DataFrame, key: str, most: int, least: float, stretch: int = STRETCH) -> DataFrame:
    """id: sets (id, tokens, key) whose Jaccard with one of the `most` before them in their key, in order of ids, is `least`. A
    key is cut into stretches that begin with the rows that their first ones look back to, so that no task holds a key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("id"))) - 1
    placed = sets.where(F.col(key).isNotNull()).select("id", key, "tokens", at.alias("at"))
    own = F.floor(F.col("at") / stretch).cast("int")
    ahead = F.floor((F.col("at") + most) / stretch).cast("int")
    dealt = placed.withColumn("stretch", F.explode(F.sequence(own, ahead)))

    def alike_ones(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        begin = rows.column("stretch")[0].as_py() * stretch
        recent: deque[frozenset] = deque(maxlen=most)
        found = []
        for k in range(len(rows)):
            x = frozenset(rows.column("tokens")[k].as_py() or ())
            if rows.column("at")[k].as_py() >= begin and x:
                for y in recent:
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    if len(small) >= least * len(large) - 1e-9 and small and (both := len(small & large)) / (len(x) + len(y) - both) >= least:
                        found.append(k)
                        break
            recent.append(x)
        return pa.table({"id": rows.column("id").take(pa.array(found, pa.int64()))})

    return dealt.groupBy(key, "stretch").applyInArrow(alike_ones, f"id {sets.schema['id'].dataType.simpleString()}")


#: Rows of a slice of a key, and pairs that are looked at together.
SLICE, LOOK = 4096, 1 << 21


#: Bytes of the table of bits that tells which set holds which word.
BITS = 1 << 25


def shared(first: list[np.ndarray], second: list[np.ndarray], a: np.ndarray, b: np.ndarray, words: int) -> np.ndarray:
    """How many codes each pair of sets shares, by bits of the second ones, so many of them at once as the table takes."""
    out = np.zeros(len(a), dtype=np.int64)
    wide = max(1, -(-words // 8))
    rows = max(1, BITS // wide)
    order = np.argsort(b, kind="stable")
    sizes = np.array([len(x) for x in first], dtype=int)
    for begin in range(0, len(second), rows):
        some = order[np.searchsorted(b[order], begin) : np.searchsorted(b[order], begin + rows)]
        if not len(some):
            continue
        part = second[begin : begin + rows]
        code, at = np.concatenate(part), np.repeat(np.arange(len(part), dtype=np.int64), [len(x) for x in part])
        bits = np.zeros(len(part) * wide, dtype=np.uint8)
        np.bitwise_or.at(bits, at * wide + (code >> 3), (1 << (code & 7)).astype(np.uint8))
        step = max(1, LOOK // max(1, int(sizes[a[some]].max())))
        for low in range(0, len(some), step):
            now = some[low : low + step]
            n = sizes[a[now]]
            asked = np.concatenate([first[k] for k in a[now]])
            hit = (bits[np.repeat((b[now] - begin) * wide, n) + (asked >> 3)] >> (asked & 7)) & 1
            out[now] = np.bincount(np.repeat(np.arange(len(now)), n), hit, minlength=len(now))
    return out


def near_sets(first: list[np.ndarray], second: list[np.ndarray], words: int, least: float, same: bool, single: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of sets of codes whose Jaccard is `least`; with `same`, both are one list and a < b. Codes are in order
    of how rare they are, those below `single` in one set only: sets that share enough share one of their first codes."""

    def heads(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in sets], dtype=int)
        take = np.where(n > 0, n - np.maximum(1, np.ceil(n * least - 1e-9)).astype(int) + 1, 0)
        return np.concatenate([x[:m] for x, m in zip(sets, take, strict=True)]) if len(sets) else np.zeros(0, np.int64), np.repeat(np.arange(len(sets)), take)

    (code, a), (other, b) = heads(first), heads(second)
    order = np.argsort(other, kind="stable")
    other, b = other[order], b[order]
    begin, end = np.searchsorted(other, code, "left"), np.searchsorted(other, code, "right")
    n, m = np.array([len(x) for x in first], dtype=int), np.array([len(x) for x in second], dtype=int)
    many, met, low = np.cumsum(end - begin), [], 0
    while low < len(code):
        high = max(low + 1, int(np.searchsorted(many, (many[low - 1] if low else 0) + LOOK, "right")))
        wide = (end - begin)[low:high]
        x = np.repeat(a[low:high], wide)
        y = b[np.repeat(begin[low:high], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)]
        good = (n[x] >= least * m[y] - 1e-9) & (m[y] >= least * n[x] - 1e-9) & ((x < y) if same else True)
        met.append(np.unique(x[good] * max(1, len(second)) + y[good]))
        low = high
    x, y = np.divmod(np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64), max(1, len(second)))
    both = shared([c[np.searchsorted(c, single) :] - single for c in first], [c[np.searchsorted(c, single) :] - single for c in second], x, y, words - single)
    near = both / np.maximum(1, n[x] + m[y] - both) >= least
    return x[near], y[near]


def alike_within(sets: DataFrame, key: str, least: float, more: tuple[str, ...] = (), slice_: int = SLICE) -> DataFrame:
    """a, b, and for each of `more` its values (c_a, c_b): all pairs of ids, a < b, of one key whose tokens' Jaccard is `least`.
    sets: (id, tokens, key, more); tokens hold no blank. A set travels as one text, once for each slice of its key, and
    words are rows nowhere; a task holds two slices."""
    held = sets.where(F.col(key).isNotNull() & F.col("id").isNotNull() & (F.size("tokens") > 0)).select("id", key, F.array_join("tokens", " ").alias("words"), *more)
    crowded = sets.groupBy(key).agg(F.ceil(F.count("*") / slice_).cast("int").alias("slices")).where("slices > 1")
    n = F.coalesce("slices", F.lit(1))
    own = held.join(F.broadcast(crowded), key, "left").withColumn("own", F.pmod(F.xxhash64("id"), n).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1))).drop("slices")
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")

    def pairs(rows: pa.Table) -> pa.Table:
        code: dict[str, int] = {}
        sets_ = [[code.setdefault(w, len(code)) for w in dict.fromkeys(x.split(" "))] for x in rows.column("words").to_pylist()]
        df = np.bincount(np.concatenate(sets_), minlength=len(code))
        rank = np.empty(len(code), dtype=np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(code))
        sets_ = [np.sort(rank[x]) for x in sets_]
        low, high, slice_of = rows.column("low")[0].as_py(), rows.column("high")[0].as_py(), rows.column("own").to_numpy()
        first, second = np.flatnonzero(slice_of == low), np.flatnonzero(slice_of == high)
        x, y = near_sets([sets_[k] for k in first], [sets_[k] for k in second], len(code), least, low == high, int((df == 1).sum()))
        x, y = first[x], second[y]
        ids = rows.column("id").to_numpy()
        x, y = np.where(ids[x] < ids[y], x, y)[ids[x] != ids[y]], np.where(ids[x] < ids[y], y, x)[ids[x] != ids[y]]
        out = {"a": rows.column("id").take(pa.array(x)), "b": rows.column("id").take(pa.array(y))}
        for c in more:
            out |= {f"{c}_a": rows.column(c).take(pa.array(x)), f"{c}_b": rows.column(c).take(pa.array(y))}
        return pa.table(out)

    kind = lambda c: sets.schema[c].dataType.simpleString()
    schema = ", ".join([f"a {kind('id')}, b {kind('id')}", *[f"{c}_a {kind(c)}, {c}_b {kind(c)}" for c in more]])
    return dealt.groupBy(key, "low", "high").applyInArrow(pairs, schema)
