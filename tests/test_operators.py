"""Operators that SQL can't say, and the edges of those that it can."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import temporal, text, vector
from palimpsest.operators import filters, fusion, graph, joins, rank, state, windows
from palimpsest.sources import collectors, snapshot
from palimpsest.streaming import windows as streams


def values(df):
    return [tuple(r) for r in df.collect()]


def test_filter_language_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, c string")
    keep = lambda w: [r[0] for r in values(df.where(filters.compile_filter(w)).select("id").orderBy("id"))]
    assert keep({"c": "a"}) == keep({"c": {"$eq": "a"}}) == [1]
    assert keep({"c": {"$ne": "a"}}) == [2, 3]
    assert keep({"c": {"$nin": ["a"]}}) == [2, 3]
    assert keep({"c": {"$in": []}}) == [] and keep({"c": {"$nin": []}}) == keep(None) == [1, 2, 3]
    assert keep({"$or": [{"c": "a"}, {"id": {"$gt": 2}}]}) == [1, 3]
    assert keep({"$and": [{"id": {"$gte": 2}}, {"id": {"$lte": 2}}]}) == [2]
    assert keep({"$or": []}) == []
    with pytest.raises(ValueError):
        filters.compile_filter({"c": {"$like": "x"}})


def test_text_functions(spark):
    df = spark.createDataFrame([("The Quick-brown fox_1 한국어 a fox_1", "mail me@x.org or 10.0.0.1, token = abc")], "a string, b string")
    t = text.tokens(F.col("a"))
    row = df.select(t.alias("t"), text.redact(F.col("b")).alias("r"), text.findings(F.col("b")).alias("f"), text.jaccard(t, F.array()).alias("j")).first()
    assert row["t"] == ["quick-brown", "fox_1", "한국어"]
    assert row["r"] == "mail [email] or [ipv4], [assigned]"
    assert row["f"] == ["email", "ipv4", "assigned"]
    assert row["j"] == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in values(df.select(vector.cosine(F.col("a"), F.col("b"))))] == [1.0, 0.0, 0.0]
    assert values(df.limit(1).select(vector.truncated(F.col("a"), 1)))[0][0] == [1.0]


def test_decay_stays_in_bounds(spark):
    now = F.expr("TIMESTAMP '2025-01-01'")
    df = spark.sql("SELECT TIMESTAMP '2025-01-01' - make_interval(0, 0, 0, CAST(id AS INT)) AS c, CAST(NULL AS TIMESTAMP) AS v FROM range(0, 2000, 90)")
    got = [r[0] for r in values(df.select(temporal.decay(F.col("c"), F.lit("context"), F.col("v"), now)))]
    assert got[0] == 1.0 and all(0.25 <= x <= 1 for x in got) and got == sorted(got, reverse=True)
    assert got[1] == pytest.approx(0.25) and got[-1] == 0.25


def test_rrf_bounds_and_order_of_sources(spark):
    lists = spark.createDataFrame([(1, "x", "a", 0), (1, "x", "b", 0), (1, "y", "a", 1), (2, "z", "b", 0)], "qid long, id string, source string, rank int")
    got = {(q, i): s for q, i, s in values(fusion.rrf(lists, {"a": 0.9, "b": 1.0}))}
    assert got[1, "x"] == pytest.approx(100) and got[2, "z"] == pytest.approx(100)
    assert got[1, "y"] == pytest.approx(100 * (0.9 / 61) / (1.9 / 60))
    again = {(q, i): s for q, i, s in values(fusion.rrf(lists.orderBy(F.desc("source")), {"a": 0.9, "b": 1.0}))}
    assert again == pytest.approx(got)


def test_greedy_choices(spark):
    c = spark.createDataFrame([(1, 1, 9.0, ["a", "b", "c"]), (1, 2, 8.0, ["a", "b", "c"]), (1, 3, 7.0, ["d"]), (1, 4, 6.0, ["a", "b"])], "qid long, id long, score double, tokens array<string>")
    assert sorted(r[1] for r in values(fusion.greedy_dedup(c, 0.8, 80))) == [1, 3, 4]
    ranked = [r[1] for r in sorted(values(fusion.mmr(c, 2, weight=0.5, least_gain=-1)), key=lambda r: r[2])]
    assert ranked[:2] == [1, 3] and sorted(ranked) == [1, 2, 3, 4]
    b = spark.createDataFrame([(1, 1, 0, 5.0, 60), (1, 2, 0, 4.0, 50), (1, 3, 1, 9.0, 40)], "qid long, id long, priority int, score double, tokens long")
    assert sorted(r[1] for r in values(fusion.budget(b, 100))) == [1, 3]


def test_stages_run_in_order_and_can_be_off(spark):
    c = spark.createDataFrame([(1, 10.0)], "id long, score double")
    chain = [rank.Stage("a", rank.added(F.lit(5))), rank.Stage("b", rank.scaled(F.lit(2))), rank.Stage("c", rank.added(F.lit(100)), enabled=False)]
    assert values(rank.run(c, chain)) == [(1, 30.0)]


def test_sessions_percentiles_and_islands(spark):
    e = spark.sql("SELECT id AS e, 1 AS u, timestamp_seconds(CASE id WHEN 0 THEN 0 WHEN 1 THEN 1800 WHEN 2 THEN 3601 ELSE 3602 END) AS ts, id < 2 AS v FROM range(4)")
    assert [r[-1] for r in sorted(values(windows.sessions(e, ["u"], "ts", "e", 1800).select("e", "session_no")))] == [0, 0, 1, 1]
    assert [r[-1] for r in sorted(values(windows.sessions(e, ["u"], "ts", "e", 1800, most=1).select("e", "session_no")))] == [0, 1, 2, 3]
    assert [r[-1] for r in sorted(values(windows.islands(e, ["u"], ["ts"], "v").select("e", "island")))] == [1, 1, 2, 2]
    p = spark.sql("SELECT array(1, 2, 3, 4) AS v").select(windows.index_percentile(F.col("v"), 0.5), windows.index_percentile(F.col("v"), 1.0))
    assert values(p) == [(3, 4)]


def test_ledger_matches_the_fold_and_the_rollback(spark):
    e = spark.createDataFrame([(1, k, 3.0 if k < 4 else -1.0, 1) for k in range(6)], "atom long, event_id long, weight double, cluster int")
    p = 0.5
    for w in (3, 3, 3, 3, -1, -1):
        p = min(0.98, max(0.02, 1 / (1 + math.exp(-(math.log(p / (1 - p)) + w)))))
    assert values(state.ledger(e))[0][1] == pytest.approx(p)
    assert values(spark.range(1).select(state.rolled_back(F.lit(0.0))))[0][0] == 0.5


def test_fact_versions(spark):
    f = spark.createDataFrame([("e", "a", "x", 1, 0.5), ("e", "a", "x", 2, 0.1), ("e", "a", "y", 3, 0.4), ("e", "a", "z", 4, 0.6)], "entity string, attribute string, value string, seq long, confidence double")
    got = {r[2]: (r[3], r[4]) for r in values(state.fact_versions(f))}
    assert got == {1: ("superseded", 4), 2: ("confirmed", None), 3: ("superseded", 1), 4: ("active", None)}


def test_breaker_and_utility(spark):
    e = spark.createDataFrame([(1, k, ok) for k, ok in enumerate([False, False, True, True, True, True])], "kind long, seq long, ok boolean")
    assert [r[2] for r in sorted(values(state.breaker(e, 2, 2)))] == ["closed", "open", "open", "half-open", "closed", "closed"]
    u = spark.createDataFrame([(1, k, True) for k in range(9)] + [(1, 9, False)], "atom long, event_id long, success boolean")
    assert values(state.utility(u))[0][1] == pytest.approx(0.95)


EDGES = [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 0.5), (3, 4, 0.25), (5, 6, 1.0)]


def test_pagerank_against_power_iteration(spark):
    e, seeds = spark.createDataFrame(EDGES, "src long, dst long, w double"), spark.createDataFrame([(1,)], "node long")
    got = dict(values(graph.pagerank(e, seeds, rounds=60, tolerance=1e-10)))
    nodes = range(1, 7)
    w = {(a, b): x for s, d, x in EDGES for a, b in ((s, d), (d, s))}
    out = {a: sum(x for (s, _), x in w.items() if s == a) for a in nodes}
    r = {n: float(n == 1) for n in nodes}
    for _ in range(200):
        r = {n: 0.15 * (n == 1) + 0.85 * sum(r[a] * w[a, n] / out[a] for a in nodes if (a, n) in w) for n in nodes}
    most = max(r[n] for n in (2, 3, 4))
    assert set(got) == {2, 3, 4}
    assert got == pytest.approx({n: r[n] / most for n in (2, 3, 4)}, abs=1e-6)


def test_communities_and_capped_clusters(spark):
    e = spark.createDataFrame(EDGES, "src long, dst long, w double")
    labels = dict(values(graph.label_propagation(e)))
    assert labels[1] == labels[2] == labels[3] and labels[5] == labels[6] != labels[1]
    clusters = dict(values(graph.capped_clusters(e, 2)))
    assert clusters[1] == clusters[2] == 1 and clusters[3] == clusters[4] == 3 and clusters[5] == clusters[6]


@pytest.mark.parametrize("most", [1, 4])
def test_capped_clusters_against_edges_one_by_one(spark, most):
    import random

    rng = random.Random(most)
    rows = [(a, b, rng.randint(1, 5) / 10) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.08] + [(3, 3, 0.9)]
    own = {n: {n} for e in rows if e[0] != e[1] for n in e[:2]}
    for a, b, _ in sorted(rows, key=lambda e: (-e[2], e[0], e[1])):
        if own[a] is not own[b] and len(own[a]) + len(own[b]) <= most:
            both = own[a] | own[b]
            own |= {n: both for n in both}
    got = dict(values(graph.capped_clusters(spark.createDataFrame(rows, "src long, dst long, w double"), most)))
    assert got == {n: min(c) for n, c in own.items()}


def test_window_join_equals_the_nested_loop(spark):
    a = spark.sql("SELECT id AS i, timestamp_seconds(id * 7 % 100) AS ta FROM range(30)")
    b = spark.sql("SELECT id AS j, timestamp_seconds(id * 13 % 100) AS tb FROM range(30)")
    got = sorted(values(joins.within_window(a, b, "ta", "tb", 9).select("i", "j")))
    assert got == sorted((i, j) for i in range(30) for j in range(30) if abs(i * 7 % 100 - j * 13 % 100) <= 9)


def test_trace_and_two_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "child long, parent long")
    assert dict(values(joins.trace(e, spark.createDataFrame([(1,)], "node long"), 5))) == {1: 0, 2: 1, 3: 2, 4: 3}
    g = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5)], "src long, dst long, w double")
    got = dict(values(joins.two_hops(g, spark.createDataFrame([(1,)], "node long"))))
    assert got == pytest.approx({2: 0.35, 3: 0.0875})


def test_snapshots(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, w string")
    assert sorted(values(snapshot.upsert(base, spark.createDataFrame([(2, "B", "Y"), (3, "c", "z")], base.schema), "id"))) == [(1, "a", "x"), (2, "B", "Y"), (3, "c", "z")]
    assert sorted(values(snapshot.patch(base, spark.createDataFrame([(2, None, "Y"), (9, "q", "q")], base.schema), "id"))) == [(1, "a", "x"), (2, "b", "Y")]


def test_collectors_read_files(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text('---\n{"title": "T", "n": 1}\n---\nbody\nmore')
    (tmp_path / "n/b.md").write_text("---\nnot json\n---\nx")
    (tmp_path / "n/c.md").write_text("no head")
    assert [(r["head"]["title"], r["body"]) for r in collectors.notes(spark, f"file://{tmp_path}/n").collect()] == [("T", "body\nmore")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text(json.dumps({"id": "1", "content": "c", "entities": ["e"]}))
    (tmp_path / "r/b.json").write_text("{broken")
    assert [(r["id"], r["entities"]) for r in collectors.records(spark, f"file://{tmp_path}/r").collect()] == [("1", ["e"])]
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps({"sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}}), json.dumps({"sessionId": "s", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "b"}]}}), "broken"]))
    assert [(r["role"], r["text"]) for r in collectors.session_lines(spark, f"file://{tmp_path}/s.jsonl").collect()] == [("user", "hi"), ("assistant", "a\nb")]
    lines = spark.createDataFrame([(": 1700000000:5;git commit -m 'x;y'",), ("plain",)], "value string")
    assert values(collectors.shell_history(lines)) == [(1700000000, 5, "git commit -m 'x;y'")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=3000), st.integers(50, 400), st.integers(0, 40))
def test_chunks_hold_all_words_in_bounds(given_text, size, overlap):
    pieces = list(collectors.chunk_text(given_text, size, overlap))
    assert all(0 < len(p) <= size + 2 for p in pieces)
    if not overlap:
        assert "".join("".join(pieces).split()) == "".join(given_text.split())


def test_stream_equals_table(spark, tmp_path):
    events = spark.sql("SELECT timestamp_seconds(id * 97) AS ts, concat('r', id % 3) AS route, CAST(id AS DOUBLE) AS latency, CAST(id % 2 AS INT) AS error, id % 4 AS session FROM range(400)")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, of in (("rolling", streams.rolling), ("sessions", streams.session_counts)):
        q = of(stream, late="1 hour").writeStream.format("memory").queryName(f"out_{name}").outputMode("complete" if name == "rolling" else "append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        got, want = sorted(values(spark.table(f"out_{name}"))), sorted(values(of(events)))
        assert got == want if name == "rolling" else set(got) <= set(want)
    q = streams.first_sightings(stream, ["session"], "1 hour").writeStream.format("memory").queryName("out_first").option("checkpointLocation", f"{tmp_path}/first").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("out_first").count() == 4


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


def test_time_expressions():
    from datetime import datetime

    from palimpsest.functions import intervals

    now = datetime(2025, 3, 5, 12, 30)  # a Wednesday
    at = lambda x: intervals.parse(x, now)
    assert at("2024-02-01") == datetime(2024, 2, 1) and at("2024-02-01T10:00:00Z") == datetime(2024, 2, 1, 10)
    assert at("2024-02-01T10:00:00+02:00") == datetime(2024, 2, 1, 8)
    assert at("7d") == at("1 week ago") == datetime(2025, 2, 26, 12, 30)
    assert at("3 hours ago") == datetime(2025, 3, 5, 9, 30)
    assert at("yesterday") == datetime(2025, 3, 4) and at("last week") == datetime(2025, 2, 24)
    assert at("monday") == datetime(2025, 3, 3) and at("wednesday") == datetime(2025, 3, 5) and at("last wednesday") == datetime(2025, 2, 26)
    assert at("soon") is None and at("") is None and at(None) is None
    assert intervals.parse_range("today", "yesterday", now) == (datetime(2025, 3, 4), datetime(2025, 3, 5))
    assert intervals.intent("what did we say yesterday?", now) == (datetime(2025, 3, 4), datetime(2025, 3, 5))
    assert intervals.intent("what happened last week", now) == (datetime(2025, 2, 24), datetime(2025, 3, 3))
    assert intervals.span("this week", now) == (datetime(2025, 3, 3), datetime(2025, 3, 10))
    assert intervals.span("last month", datetime(2025, 1, 31)) == (datetime(2024, 12, 1), datetime(2025, 1, 1))
    assert intervals.span("this month", datetime(2024, 12, 31)) == (datetime(2024, 12, 1), datetime(2025, 1, 1))
    assert intervals.span("last year", now) == (datetime(2024, 1, 1), datetime(2025, 1, 1))
    assert at("1m") == datetime(2025, 2, 3, 12, 30) and at("1y") == datetime(2024, 3, 5, 12, 30) and at("2mo") == datetime(2025, 1, 4, 12, 30)
    assert intervals.parse_range("last month", None, now) == (datetime(2025, 2, 1), datetime(2025, 3, 1))
    assert intervals.intent("no time", now) == (None, None)


def test_complete_link(spark):
    p = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.1]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0])], "group long, id long, embedding array<double>")
    assert sorted(values(graph.complete_link(p, 0.9, 12))) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 4, 0)]


def test_negation_and_particles(spark):
    from palimpsest.operators import governance

    texts = ["use codex here", "this is not about codex", "it isn't codex at all", "not sure, but I should perhaps use codex", "not codex, but then codex again and well codex", ""]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").select("k", governance.has_unnegated(F.col("t"), "codex").alias("m")).orderBy("k").collect()
    assert [r["m"] for r in got] == [True, False, False, True, True, False]
    words = ["크리스가", "회의", "서버에서는", "port", "파일"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(words)], "k int, t string").select("k", governance.stem(F.col("t")).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == ["크리스", "회의", "서버", "port", "파일"]


def test_diversity_keeps_all_and_moves_what_crowds(spark):
    from palimpsest.operators import governance

    sources = "aaaabbacda"
    df = spark.createDataFrame([(1, k, s, k) for k, s in enumerate(sources, 1)], "qid int, id int, source string, rank int")
    chosen, late = [], []
    for k, s in enumerate(sources, 1):
        (late if sources[:k].count(s) > 2 and len(chosen) < 5 else chosen).append(k)
    got = [r["id"] for r in governance.diversified(df).orderBy("place").collect()]
    assert got == chosen + late


def test_rules_fold_into_one_score(spark):
    from palimpsest.operators import governance

    df = spark.createDataFrame([(1, 10.0, "x"), (2, 10.0, None)], "id int, score double, path string")
    rules = (governance.Rule("named", "path = 'x'", 5.0), governance.Rule("lost", "path IS NULL", -3.0))
    assert sorted(values(governance.governed(df, rules))) == [(1, 15.0, "x", ["named"]), (2, 7.0, None, ["lost"])]


def test_chunks_by_heading_and_merged(spark):
    from palimpsest.sources import chunks

    long = "word " * 40
    note = f"---\nid: 1\n---\nintro {long}\n# One\n{long}\n## Tiny\nx\n### Two\n{long * 4}\n#### deep\n{long}"
    df = spark.createDataFrame([(1, note), (2, "short"), (3, None)], "id int, note string")
    got = sorted(values(chunks.by_heading(df, "id", "note").select("id", "place", "section")))
    assert got == [(1, 0, "intro"), (1, 1, "One"), (1, 2, "Two"), (2, 0, "full"), (3, 0, "full")]
    merged = chunks.merged_sections(chunks.by_heading(df.where("id < 3"), "id", "note"), "id", 700, 1500)
    assert [r["section"] for r in merged.where("id = 1").orderBy("place").collect()] == ["intro + One + Two"]


def test_folds_keep_their_state_over_batches(spark):
    from palimpsest.operators import state

    df = spark.range(5000).selectExpr("id % 3 AS atom", "id AS event_id", "id % 2 = 0 AS success")
    want = {}
    for k in range(5000):
        want[k % 3] = min(1.0, max(0.0, want.get(k % 3, 0.5) + (0.1 if k % 2 == 0 else -0.05)))
    got = dict(values(state.utility(df)))
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert values(state.utility(df.limit(0))) == []
