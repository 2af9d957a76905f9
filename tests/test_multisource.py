"""Search over many sources, analogs, and stored runs against plain code."""

import datetime
import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import multisource, runs
from palimpsest.plans import multisource as plans
from palimpsest.session import Tables

WORDS = [f"word{k}" for k in range(30)]
NOW = datetime.datetime(2025, 1, 1)


def said(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / n, 4) if n else 0.0


def test_collections_against_plain_code(spark):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    docs = [(k, f"c{k % 3}", "word1" if k % 5 == 0 else "x", said(rng, 6) if k % 7 else "same text", vector()) for k in range(300)]
    asked = [(q, said(rng, 4), vector()) for q in range(5)]
    asked.append((0, asked[0][1], vector()))  # a variant of the first
    signal = lambda q, c, p: F.when(F.array_contains(q, p), 0.3).when(c == "c1", -0.05).otherwise(0.0)
    odd = [(None, "c0", "x", "word1", vector()), (900, "c0", "x", "word1", None), (901, "c1", None, None, vector())]
    got = multisource.collections_search(
        spark.createDataFrame([*asked, (77, None, None)], "qid long, text string, vector array<double>"),
        spark.createDataFrame([*docs, *odd], "id long, collection string, path string, text string, vector array<double>"), 10, signal).collect()
    for qid in range(5):
        own = [v for q, _, v in asked if q == qid]
        words = set(next(text for q, text, _ in asked if q == qid).split())
        best = {}
        for v in own:
            for c in ("c0", "c1", "c2"):
                near = sorted(((-plain_cosine(v, d[4]), d[0], d) for d in [*docs, odd[2]] if d[1] == c), key=lambda x: x[:2])[:30]
                for minus, id_, d in near:
                    best[id_] = max(best.get(id_, (-2, None)), (-minus, d), key=lambda x: x[0])
        scored = {}
        for id_, (v, d) in best.items():
            kw = len(words & set((d[3] or "").split())) / len(words)
            s = 0.3 if d[2] in words else -0.05 if d[1] == "c1" else 0
            v = max(0, v)
            score = 0.55 * v + 0.35 * kw + 0.10 * max(-0.2, min(1, s / 0.45)) if s else 0.61 * v + 0.39 * kw
            score = round(min(1, max(0, score)), 4)
            text = d[3] or ""
            if text not in scored or (-score, id_) < scored[text]:
                scored[text] = (-score, id_)
        want = sorted(scored.values())[:10]
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["qid"] == qid)
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert [m[2] for m in mine] == pytest.approx([-w[0] for w in want], abs=1e-4)
    assert not [r for r in got if r["qid"] == 77]


def test_composition_weighs_by_intent_and_leaves_out_empty_lists(spark):
    questions = spark.createDataFrame([(1, "who is the owner"), (2, "plain"), (3, None)], "qid long, text string")
    lists = spark.createDataFrame([(q, i, s, r) for q in (1, 2, 3) for s, rows in (("rag", "ab"), ("graph", "bc"), ("unknown", "z")) for r, i in enumerate(rows)], "qid long, id string, source string, rank int")
    got = {(r["qid"], r["id"]): r["score"] for r in multisource.composed(lists, questions).collect()}
    for qid, rag, graph in ((1, 0.9 * 1.2, 0.5 * 0.9), (2, 0.9, 0.5), (3, 0.9, 0.5)):
        most = (rag + graph) / 60
        assert got[qid, "a"] == pytest.approx(100 * rag / 60 / most)
        assert got[qid, "b"] == pytest.approx(100 * (rag / 61 + graph / 60) / most)
        assert got[qid, "c"] == pytest.approx(100 * graph / 61 / most)
    assert not [k for k in got if k[1] == "z"]


def test_every_source_has_a_list(spark):
    rows = plans.source_lists(Tables(spark, "/root/testdata/sf0.001")).groupBy("source").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    found = {r["source"]: r["last"] for r in rows}
    assert set(found) == set(multisource.SOURCES)
    assert all(found[s] < n for s, n in plans.LENGTHS.items())


def test_analogs_against_plain_code(spark):
    rng = random.Random(9)
    common = ["very", "common"]
    events = [(k, f"r{rng.randrange(6)}" if k % 50 else None, " ".join([said(rng, 3), *(common if k % 3 else [])]), rng.choice([*multisource.SETTLED, "open", None]), NOW - datetime.timedelta(days=rng.randrange(300))) for k in range(3000)]
    asked = [(q, f"{'Very ' if q % 2 else ''}{said(rng, 2)} of a", f"r{q % 6}" if q % 4 else None) for q in range(12)]
    asked += [(50, None, "r1"), (51, " ".join(f"absent{k}" for k in range(12)) + " very", "r1")]
    got = multisource.analogs(spark.createDataFrame(asked, "qid long, text string, repo string"), spark.createDataFrame(events, "id long, repo string, text string, outcome string, ts timestamp"), F.lit(NOW)).collect()
    for qid, question, own in asked:
        words = set([w for w in re.findall(r"[a-z0-9_]+", (question or "").lower()) if len(w) >= 3][:12])
        live = [e for e in events if e[1] and e[3] in multisource.SETTLED and e[4] > NOW - datetime.timedelta(days=180) and words & set(e[2].split())]
        seen = {}
        for e in sorted(live, key=lambda e: (e[4], e[0]), reverse=True)[:200]:
            if e[1] != own:
                seen.setdefault(e[1], e[0])
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])] == list(seen.values())[:5]


def run(spark, **tracks):
    return spark.createDataFrame([(t, *v) for t, v in tracks.items()], "track string, total long, content double, source double")


def test_gate_on_stored_runs(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    at = lambda d: F.lit(NOW + datetime.timedelta(days=d))
    verdicts = lambda df: {r["track"]: r["verdict"] for r in df.collect()}
    assert verdicts(runs.settle(run(spark, a=(10, 80.0, 60.0), b=(10, 50.0, 0.0)), folder, at(0))) == {"a": "first", "b": "first"}
    assert verdicts(runs.settle(run(spark, a=(10, 80.0, 60.0), b=(10, 50.0, 0.0)), folder, at(0))) == {"a": "passed", "b": "passed"}  # run again
    assert verdicts(runs.settle(run(spark, a=(10, 75.0, 50.0), b=(11, 10.0, 0.0)), folder, at(1))) == {"a": "passed", "b": "resized"}
    assert verdicts(runs.settle(run(spark, a=(10, 74.9, 60.0), b=(11, 10.0, 0.0)), folder, at(2))) == {"a": "failed", "b": "passed"}
    assert verdicts(runs.settle(run(spark, a=(10, 80.0, 49.9)), folder, at(3))) == {"a": "failed"}
    assert verdicts(runs.settle(run(spark, a=(10, 76.0, 60.0), b=(11, 4.0, 0.0)), folder, at(20))) == {"a": "aged", "b": "failed"}
    assert verdicts(runs.settle(run(spark, a=(10, 72.0, 60.0)), folder, at(21))) == {"a": "passed"}  # 76 is the baseline now
    assert verdicts(runs.gate(run(spark, a=(10, 60.0, 60.0)), runs.baseline(runs.stored(spark, folder)), at(21), only_below=50)) == {"a": "passed"}
    assert verdicts(runs.gate(run(spark, a=(10, 76.0, 55.0)), runs.baseline(runs.stored(spark, folder)), at(21), least_source=56)) == {"a": "failed"}


def test_a_run_written_twice_is_one_baseline(spark):
    twice = spark.createDataFrame([("a", 3, 50.0, 40.0, NOW)] * 2, runs.SCHEMA)
    assert runs.baseline(twice).count() == 1


def test_report_counts_nulls_as_misses(spark):
    cases = spark.createDataFrame([("a", True, None), ("a", None, False), ("a", True, True)], "track string, content boolean, source boolean")
    r = runs.report(cases).first()
    assert (r["total"], r["content"], r["source"]) == (3, pytest.approx(66.6667), pytest.approx(33.3333))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, collection string, path string, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "word1", [1.0])], "qid long, text string, vector array<double>")
    assert multisource.collections_search(asked, none, 5).count() == 0
    events = spark.createDataFrame([], "id long, repo string, text string, outcome string, ts timestamp")
    assert multisource.analogs(asked.withColumn("repo", F.lit("r")), events, F.lit(NOW)).count() == 0
