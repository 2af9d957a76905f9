"""Whitening against exact sums in plain code, and numpy."""

import numpy as np
import pytest

from palimpsest.llm import whitening
from palimpsest.llm.queries import queries

from .conftest import SF


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").repartition(5)


def random_rows(n, d, seed=1, scale=None):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(size=d) * (scale if scale is not None else np.linspace(0.1, 2, d))).tolist(), 0) for k in range(n)]


def exact(vectors):
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    scatter = [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]
    return x, n, sums, scatter


def check(got, vectors, ids):
    x, n, sums, scatter = exact(vectors)
    d = len(sums)
    v = np.array([[(n * scatter[i][j] - sums[i] * sums[j]) / n**2 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, d)
    by = {}
    for r in got:
        assert r["n"] == n
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(ids) and all(set(v) == set(range(1, k + 1)) for v in by.values())
    centred = np.array([[n * a - s for a, s in zip(r, sums, strict=True)] for r in x], dtype=float) / n
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    w = np.array([[by[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * sign, atol=1e-6)
    for i, r in zip(ids, x, strict=True):
        assert by[i][1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))
    assert np.allclose([by[ids[0]][c + 1]["explained"] for c in range(k)], values[:k] / values.sum(), rtol=1e-9)
    off = (w - w.mean(axis=0)).T @ (w - w.mean(axis=0)) / n - np.eye(k)
    told = {r["identity_error"] for r in got}
    assert len(told) == 1 and abs(told.pop() - np.abs(off).max()) < 1e-9 < 1e-4


@pytest.mark.parametrize(("n", "d"), [(500, 12), (40, 3), (9, 16)])
def test_equals_plain_code(spark, n, d):
    rows = random_rows(n, d)
    got = whitening.whiten(table(spark, rows)).collect()
    if n > d:
        check(got, [r[1] for r in rows], [r[0] for r in rows])
    else:
        assert max(r["identity_error"] for r in got) < 1e-4


def test_op13_is_the_whole_table(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(queries()["op13_whitening"](spark, SF).collect(), [r["embedding"] for r in given], [r["vec_id"] for r in given])


@pytest.mark.parametrize("size", [1.0, 1e6, 1e12, 1e300])
def test_the_scatter_is_exact(spark, size):
    vectors = [[float(c) * size for c in r[1]] for r in random_rows(300, 5)]
    models = whitening.fit(whitening.fit_list(table(spark, [(k, v, 0) for k, v in enumerate(vectors)])))
    x = [[min(max(int(np.floor(1024 * c)) if abs(c) < 1e300 else (1 if c > 0 else -1) * 2**62, -(2**62)), 2**62) + 100000 for c in v] for v in vectors]
    assert models[5].n == 300
    assert models[5].sums == [sum(r[i] for r in x) for i in range(5)]
    assert models[5].scatter == [[sum(r[i] * r[j] for r in x) for j in range(5)] for i in range(5)]


def test_odd_rows(spark):
    good = random_rows(50, 4)
    odd = [(100, None, 1), (101, [], 1), (102, [1.0, None, 1.0, 1.0], 1), (103, [1.0, float("nan"), 1.0, 1.0], 1), (104, [float("inf")] * 4, 1), (None, [0.5, 0.5, 0.5, 0.5], 1), (7, good[7][1], 1)]
    got = whitening.whiten(table(spark, good + odd)).collect()
    assert len(got) == 52 * 4 and {r["n"] for r in got} == {52}
    assert sorted({r["vec_id"] for r in got if r["vec_id"] is not None}) == list(range(50))
    assert sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 7 for r in got) == 8
    assert whitening.whiten(table(spark, good).limit(0)).collect() == []
    same = whitening.whiten(table(spark, [(k, [1.0, 2.0], 0) for k in range(5)])).collect()
    assert {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same} == {(0.0, 0.0, 0, 0.0)}


def test_lengths_are_fitted_apart(spark):
    a, b = random_rows(60, 4), [(1000 + k, v, 0) for k, v, _ in random_rows(30, 6, 2)]
    got = whitening.whiten(table(spark, a + b)).collect()
    assert {(r["n"], r["vec_id"] >= 1000) for r in got} == {(60, False), (30, True)}
    alone = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table(spark, a)).collect()}
    for r in got:
        if r["vec_id"] < 1000:
            one = alone[r["vec_id"], r["component"]]
            assert (r["deviation"], r["explained"]) == (one["deviation"], one["explained"]) and abs(r["whitened"] - one["whitened"]) < 1e-9


def test_deviations_at_the_edge_of_64_bits():
    model = whitening.Model(10**9, [0, 0], [], np.ones(2), np.eye(2), 2.0)
    x = np.array([[3, 0], [2, 2], [4, 0], [3, 1]], dtype=np.int64)
    want = [min(whitening.LARGEST, sum((10**9 * int(c)) ** 2 for c in r)) for r in x]
    assert model.squares(x).tolist() == want
    wide = whitening.Model(10**12, [5, -7], [], np.ones(2), np.eye(2), 2.0)
    y = np.array([[0, 0], [1, 0], [10**10, 1]], dtype=np.int64)
    assert wide.squares(y).tolist() == [min(whitening.LARGEST, sum((10**12 * int(c) - s) ** 2 for c, s in zip(r, (5, -7), strict=True))) for r in y]


def test_partial_sums_are_added_in_rounds(spark, monkeypatch):
    rows = random_rows(200, 4)
    monkeypatch.setattr(whitening, "AT_ONCE", 2)
    check(whitening.whiten(table(spark, rows)).collect(), [r[1] for r in rows], [r[0] for r in rows])
