"""Communities, activation and the vector index against plain code."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import activation, communities, index
from palimpsest.operators.graph import cut


def planted(groups, size, inside, outside, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0 if a // size == b // size else 0.6) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else outside)]


def plain_modularity(edges, of):
    m2, degree, inside = 0.0, defaultdict(float), 0.0
    for a, b, w in edges:
        m2 += 2 * w
        degree[of[a]] += w
        degree[of[b]] += w
        inside += 2 * w * (of[a] == of[b])
    return inside / m2 - sum((d / m2) ** 2 for d in degree.values())


def plain_louvain(edges):
    """Sequential: nodes one by one to the neighbouring community of greatest gain, then the graph of communities."""
    around = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        around[a][b] += w
        around[b][a] += w
    k = {n: sum(x.values()) for n, x in around.items()}
    m2 = sum(k.values())
    of = {n: n for n in around}
    while True:
        own = {n: n for n in around}
        total = dict(k)
        moved_ever = False
        while True:
            moved = False
            for n in sorted(around):
                links = defaultdict(float)
                for x, w in around[n].items():
                    if x != n:
                        links[own[x]] += w
                total[own[n]] -= k[n]
                best = max([own[n], *sorted(links)], key=lambda c: links.get(c, 0.0) - k[n] * total[c] / m2)
                gain = (links.get(best, 0.0) - k[n] * total[best] / m2) - (links.get(own[n], 0.0) - k[n] * total[own[n]] / m2)
                if gain > 1e-12:
                    own[n], moved, moved_ever = best, True, True
                total[own[n]] += k[n]
            if not moved:
                break
        if not moved_ever:
            return of
        of = {n: own[c] for n, c in of.items()}
        next_around, next_k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, x in around.items():
            next_k[own[a]] += k[a]
            for b, w in x.items():
                next_around[own[a]][own[b]] += w
        around, k = next_around, dict(next_k)


@pytest.mark.parametrize(("shape", "seed"), [((10, 12, 0.7, 0.05), 2)])
def test_louvain_is_as_good_as_a_sequential_one(spark, shape, seed):
    edges = planted(*shape, seed)
    labels = communities.louvain(spark.createDataFrame(edges, "src long, dst long, w double").repartition(3))
    got = {r["node"]: r["community"] for r in labels.collect()}
    assert set(got) == {x for a, b, _ in edges for x in (a, b)}
    members = defaultdict(list)
    for n, c in got.items():
        members[c].append(n)
    assert all(min(m) == c for c, m in members.items())
    mine, plain = plain_modularity(edges, got), plain_modularity(edges, plain_louvain(edges))
    assert mine >= 0.98 * plain
    assert communities.modularity(spark.createDataFrame(edges, "src long, dst long, w double"), labels) == pytest.approx(mine, abs=1e-6)


def test_no_round_lowers_modularity(spark):
    edges = planted(5, 16, 0.4, 0.08, 3) + [(0, 1, 1e-9), (3, 3, 1.0), (4, 5, 0.5), (5, 4, 0.9)]
    given = spark.createDataFrame(edges, "src long, dst long, w double")
    e = cut(communities.plain_edges(given))
    state = e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node"))
    whole, before = float(e.agg(F.sum("w")).first()[0]), None
    q = communities.modularity(given, state)
    for number in range(6):
        state = cut(communities.one_round(e, state.drop("gain"), whole, number))
        now = communities.modularity(given, state)
        sure = state.agg(F.sum("gain")).first()[0] or 0.0
        assert now >= q + sure - 1e-9
        before, q = q, now
    assert q > 0.2 and before is not None


def test_louvain_of_odd_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert communities.louvain(none).collect() == []
    two = spark.createDataFrame([(1, 2, 1.0), (8, 9, 1.0), (7, 7, 1.0)], "src long, dst long, w double")
    assert {(r["node"], r["community"]) for r in communities.louvain(two).collect()} == {(1, 1), (2, 1), (8, 8), (9, 8)}


def power(edges, seeds, damping=0.85, rounds=400):
    """Personalised PageRank of one question by plain iteration; nodes without edges give back to the seeds."""
    w = {}
    for a, b, x in edges:
        if a != b:
            w[a, b] = w[b, a] = max(x, w.get((a, b), 0))
    nodes = sorted({a for a, _ in w} | set(seeds))
    at = {n: k for k, n in enumerate(nodes)}
    p = np.zeros((len(nodes), len(nodes)))
    for (a, b), x in w.items():
        p[at[a], at[b]] = x
    all_ = p.sum(axis=1)
    start = np.array([n in seeds for n in nodes], dtype=float) / len(seeds)
    p = np.where(all_[:, None] > 0, p / np.maximum(all_, 1e-30)[:, None], start)
    r = start.copy()
    for _ in range(rounds):
        r = damping * (r @ p) + (1 - damping) * start
    return dict(zip(nodes, r, strict=True))


def test_activation_of_many_questions_at_once(spark, monkeypatch):
    edges = planted(4, 10, 0.4, 0.05, 5)
    asked = {1: {0, 3}, 2: {15}, 3: {22, 999}, 4: {999}, 5: set(range(40))}
    given = spark.createDataFrame(edges, "src long, dst long, w double")
    seeds = spark.createDataFrame([(q, n) for q, s in asked.items() for n in s] + [(1, 0)], "question long, node long")
    got = defaultdict(dict)
    pushed = cut(activation.pushed(given, seeds))
    for r in pushed.collect():
        assert r["left"] <= 1e-4 / (1 - 0.85)
        got[r["question"]][r["node"]] = r["settled"]
    told = defaultdict(dict)
    monkeypatch.setattr(activation, "pushed", lambda *_: pushed)
    for r in activation.activations(given, seeds).collect():
        told[r["question"]][r["node"]] = r["activation"]
    for q, s in asked.items():
        want = power(edges, s)
        assert all(abs(got[q].get(n, 0) - x) < 1e-4 * len(want) for n, x in want.items())
        others = {n: x for n, x in want.items() if n not in s and x > 0}
        assert set(told[q]) == set(others)
        if others:
            assert max(told[q].values()) == 1.0
            assert all(abs(told[q][n] - x / max(others.values())) < 0.1 for n, x in others.items())


def test_the_gate_reads_activation_only_where_scores_are_near(spark):
    results = spark.createDataFrame([(1, 10, 90.0, 1), (1, 11, 85.0, 2), (1, 12, 82.0, 3), (1, 13, 10.0, 11), (2, 10, 90.0, 1), (2, 11, 60.0, 2), (2, 12, 50.0, 3), (3, 10, 5.0, 1)], "question long, id long, score double, rank int")
    named = spark.createDataFrame([(11, 5), (11, 6), (12, 7), (13, 5)], "id long, node long")
    active = spark.createDataFrame([(1, 5, 0.4), (1, 6, 1.0), (2, 5, 1.0)], "question long, node long, activation double")
    got = {(r["question"], r["id"]): r["score"] for r in activation.gated_bonus(results, named, active).collect()}
    assert got == {(1, 10): 90.0, (1, 11): 90.0, (1, 12): 82.0, (1, 13): 10.0, (2, 10): 90.0, (2, 11): 60.0, (2, 12): 50.0, (3, 10): 5.0}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    x[:500] = x[0] + 0.05 * rng.normal(size=(500, 16))  # a third is in one place
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(None, rows[0][1]), (9000, None), (9001, []), (9002, [1.0, None]), (9003, [float("nan")] * 16), (9004, [1.0, 2.0]), (9005, [2.0, 4.1])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5), x


def test_the_index_is_exact_with_all_lists_and_finds_most_with_few(spark, clustered):
    df, x = clustered
    own = index.Index(df, piece=20)
    assert own.rows.count() == 1502 and own.pieces.agg(F.max("pieces")).first()[0] > 3
    asked = df.where("vec_id % 20 = 0 or vec_id = 9004")
    exact = own.search(asked, 10)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in exact.orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["id"], r["cosine"]))
    for q in range(0, 1500, 20):
        cosine = np.round(u @ u[q], 4)
        want = sorted(((-c, k) for k, c in enumerate(cosine.tolist()) if k != q))[:10]
        assert [c for _, c in got[q]] == pytest.approx([-c for c, _ in want], abs=1.1e-4)
    assert [i for i, _ in got[9004]] == [9005]
    hits = index.recall(own.search(asked, 10, probes=12), exact).agg(F.sum("hits"), F.sum("wanted")).first()
    assert hits[0] / hits[1] >= 0.95


def test_the_index_of_nothing(spark, clustered):
    df, _ = clustered
    none = index.Index(df.limit(0))
    assert none.search(df.where("vec_id = 20"), 3).collect() == []
    assert index.Index(df).search(df.limit(0), 3).collect() == []
