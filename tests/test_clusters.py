"""Greedy clusters, trees, spectral clusters and the likeness of titles against plain Python."""

import difflib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import plans
from palimpsest.functions import likeness
from palimpsest.operators import graph, greedy, index, spectral
from palimpsest.plans import clusters


@pytest.fixture(scope="module")
def points(spark):
    """Clumps of several widths, one of them a third of all; copies; a chain; rows that are no points."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 12))
    x = centres[rng.integers(0, 25, 600)] + rng.choice([0.15, 0.3, 0.5], size=(600, 1)) * rng.normal(size=(600, 12))
    x[::3] = x[0] + 0.25 * rng.normal(size=(200, 12))
    x[40:60] = x[39]
    ids = rng.permutation(2000)[:600]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    odd = [(None, x[0].tolist()), (5000, None), (5001, []), (5002, [1.0, None]), (5003, [float("nan")] * 12), (5004, [1.0, 0.0]), (5005, [2.0, 0.1]), (5006, [0.0] * 12)]
    df = spark.createDataFrame(rows + odd + [rows[3], rows[4]], "id long, embedding array<double>").repartition(7)
    return df, dict(rows)


def sequential(points, least, most, centroid=False):
    own = []
    for i in sorted(points):
        v = np.array(points[i]) / np.linalg.norm(points[i])
        best = None
        for c in own:
            if len(c) < most:
                if centroid:
                    m = np.sum([y for _, y in c], axis=0)
                    like = round(float(m @ v / np.linalg.norm(m)), 9)
                    if like >= least and (best is None or like > best[0]):
                        best = (like, c)
                elif all(round(float(y @ v), 9) >= least for _, y in c):
                    best = (0, c)
                    break
        if best:
            best[1].append((i, v))
        else:
            own.append([(i, v)])
    return {i: c[0][0] for c in own for i, _ in c}


@pytest.mark.parametrize("prefix", [16, 1024])
def test_complete_link_as_one_by_one(spark, points, prefix):
    df, plain = points
    got = {r["id"]: r["cluster"] for r in greedy.complete_link(df, 0.75, 12, prefix).collect()}
    want = sequential(plain, 0.75, 12)
    assert {i: got[i] for i in plain} == want
    assert len(set(want.values())) < 300
    assert {i: c for i, c in got.items() if i >= 5000} == {5004: 5004, 5005: 5004, 5006: 5006}


@pytest.mark.parametrize("prefix", [16, 1024])
def test_clusters_by_centroid_as_one_by_one(spark, points, prefix):
    df, plain = points
    got = {r["id"]: r["cluster"] for r in greedy.by_centroid(df, 0.88, 30, 3, prefix).collect()}
    want = sequential(plain, 0.88, 30, centroid=True)
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert got == {i: c for i, c in want.items() if sizes[c] >= 3}
    assert max(sizes.values()) == 30


def test_nothing_to_cluster(spark, points):
    df, _ = points
    assert greedy.complete_link(df.limit(0)).collect() == []
    assert greedy.by_centroid(df.where("id >= 5006")).collect() == []
    assert greedy.tree(df.limit(0)).collect() == []


def test_tree_has_clusters_of_clusters(spark, points):
    df, plain = points
    got = defaultdict(set)
    for r in greedy.tree(df.where("id < 5000"), 0.75, 12, 3, 4).collect():
        got[r["level"], r["node"]].add(r["child"])
    level = {i: np.array(v) for i, v in plain.items()}
    want = {}
    for k in (1, 2, 3):
        if len(level) <= 4:
            break
        members = defaultdict(list)
        for i, c in sequential(level, 0.75, 12).items():
            members[c].append(i)
        want |= {(k, c): set(m) for c, m in members.items() if len(m) > 1}
        level = {c: np.mean([level[i] for i in m], axis=0) for c, m in members.items()}
    assert dict(got) == want
    assert {k for k, _ in want} == {1, 2, 3}


def test_range_search_is_exact_and_leaves_lists_out(spark, points):
    df, plain = points
    own = index.Index(df.where("id < 5000").dropDuplicates(["id"]), id_="id", piece=30)
    got = {(r["qid"], r["id"]): r["cosine"] for r in own.within(df.where("id % 5 = 0").dropDuplicates(["id"]), 0.9, "id").collect()}
    ids = sorted(plain)
    u = index.unit(np.array([plain[i] for i in ids]))
    cosine = np.round(u @ u.T, 9)
    want = {(ids[a], ids[b]): cosine[a, b] for a, b in np.argwhere(cosine >= 0.9) if a != b and ids[a] % 5 == 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    reach = own.radii() + index.between(0.9) + 1e-6
    assert (index.between(u @ own.centroids.T) <= reach).mean() < 0.7


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(220)] + [(7000, 7000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for n in list(parent)}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def planted(sizes, inside, between, seed):
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(len(sizes)), sizes)
    a, b = np.triu_indices(len(of), 1)
    keep = rng.random(len(a)) < np.where(of[a] == of[b], inside, between)
    return of, [(int(x), int(y), float(w)) for x, y, w in zip(a[keep], b[keep], rng.uniform(0.5, 1.0, keep.sum()), strict=True)]


def dense(edges, n):
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    root = 1 / np.sqrt(w.sum(axis=1))
    return np.eye(n) - root[:, None] * w * root


def test_spectral_clusters_and_their_subspace(spark):
    of, edges = planted([90, 60, 50, 40, 30], 0.5, 0.02, 8)
    df = spark.createDataFrame([*edges, (3, 3, 9.0), (5, 6, 0.0), (999, 999, 1.0)], "src long, dst long, w double")
    block, values = spectral.smallest(spectral.weights(df))
    got = {r["node"]: r["cluster"] for r in spectral.by_vectors(block, values, len(of)).collect()}
    first = {c: int(np.flatnonzero(of == c)[0]) for c in range(5)}
    assert got == {i: first[c] for i, c in enumerate(of)}
    want, vectors = np.linalg.eigh(dense(edges, len(of)))
    assert np.abs(values[: spectral.COUNTED] - want[: spectral.COUNTED]).max() < 1e-3
    rows = block.orderBy("node").toPandas()[[f"x{k}" for k in range(5)]].to_numpy()
    assert np.linalg.norm(rows @ rows.T - vectors[:, :5] @ vectors[:, :5].T, 2) < 1e-3


def test_spectral_on_parts_and_small_graphs(spark):
    clumps = [(10 * p + a, 10 * p + b, 1.0) for p in range(4) for a in range(8) for b in range(a)]
    got = {r["node"]: r["cluster"] for r in spectral.spectral(spark.createDataFrame([*clumps, (0, 10, 0.5), (20, 30, 0.5)], "src long, dst long, w double")).collect()}
    assert got == {10 * p + a: 10 * p for p in range(4) for a in range(8)}
    two = spectral.spectral(spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double")).collect()
    assert {r["node"] for r in two} == {1, 2}
    assert spectral.spectral(spark.createDataFrame([], "src long, dst long, w double")).collect() == []


def test_number_of_clusters():
    assert spectral.number_of_clusters(np.array([0, 0.01, 0.02, 0.5, 0.6]), 100) == 3
    assert spectral.number_of_clusters(np.array([0, 0, 0, 0.2, 0.9, 0.95]), 100) == 4
    assert spectral.number_of_clusters(np.array([0.0, 0.4]), 100) == 2
    assert spectral.number_of_clusters(np.array([0] * 14), 100) == 2
    assert spectral.number_of_clusters(np.array([0, 0.01, 0.02, 0.03, 0.9]), 7) == 2


def test_likeness_of_titles_is_that_of_difflib(spark):
    rng = random.Random(5)
    words = ["plan", "plane", "Rollen", "한국어", "naïve", "x", "aaaa", "aab", "", "😀 ok", "abcabcab"]
    texts = ["", " ", "a" * 300, "ab" * 150, *(" ".join(rng.choices(words, k=rng.randrange(1, 7))) for _ in range(36))]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame([*pairs, (None, "a"), (None, None)], "a string, b string")
    out = df.select("a", "b", likeness.ratio(F.col("a"), F.col("b")).alias("r"), likeness.ratio_at_most(F.col("a"), F.col("b")).alias("m")).collect()
    assert len(out) == len(pairs) + 2
    for r in out:
        want = difflib.SequenceMatcher(None, r["a"] or "", r["b"] or "", autojunk=False).ratio()
        assert r["r"] == pytest.approx(want, abs=1e-12) and r["m"] >= r["r"] - 1e-12


def test_title_targets_are_those_of_plain_code(spark):
    sf = "/root/testdata/sf0.01"
    parts = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        parts[r["p_type"], r["p_size"]].append(r)
    want = {}
    for own in parts.values():
        for a in own:
            scored = []
            for b in own:
                x, y = set(a["p_name"].split()), set(b["p_name"].split())
                like = max(difflib.SequenceMatcher(None, a["p_name"], b["p_name"], autojunk=False).ratio(), 0.6 * len(x & y) / len(x | y))
                score = round(like + (0.2 if a["p_brand"] == b["p_brand"] else 0.0), 4)
                if a is not b and score >= clusters.LIKE:
                    scored.append((-score, b["p_partkey"]))
            want |= {(a["p_partkey"], k): -s for s, k in sorted(scored)[:3]}
    got = {(r["proposal"], r["note"]): r["score"] for r in plans.queries()["set_title_targets"](spark, sf).collect()}
    assert len(got) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)
