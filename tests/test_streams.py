"""Folds on streams equal folds on tables, over several batches and a restart; ingestion is idempotent."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import state
from palimpsest.streaming import folds, ingest

START = datetime.datetime(2024, 1, 1)


def events(n=300, seed=1):
    rng, at, out = random.Random(seed), 0.0, []
    for k in range(n):
        at += rng.choice([1, 5, 20, 90])
        out.append((f"s{rng.randrange(4)}", at, START + datetime.timedelta(seconds=at), k, rng.random() < 0.2, [rng.choice([1.0, 0.9, -1.0]), rng.choice([0.0, 0.1, 1.0])]))
    return out


SCHEMA = "k string, at double, ts timestamp, event long, helped boolean, embedding array<double>"

CASES = {
    "cooldown": (["at", "event"], [], folds.Cooldown, "k string, event long, fires long", (100,)),
    "habituation": (["at", "event"], ["helped"], folds.Habituation, "k string, event long, shown long", (3,)),
    "cache": (["at"], ["event", "embedding"], folds.SemanticCache, "k string, event long, answered_by long", (0.92, 60, 3)),
}


def replay(rows, name):
    """In plain code."""
    out = set()
    kept = {}
    for k, at, _, event, helped, embedding in sorted(rows, key=lambda r: (r[1], r[3])):
        if name == "cooldown":
            last, n = kept.get(k, (None, 0))
            if last is None or at - last >= 100:
                kept[k] = (at, n + 1)
                out.add((k, event, n + 1))
        elif name == "habituation":
            shown = 0 if helped else kept.get(k, 0) + 1
            if shown == 3:
                out.add((k, event, 3))
            kept[k] = shown % 3
        else:
            alive = [e for e in kept.get(k, []) if at - e[0] < 60]
            cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
            found = next((e[1] for e in alive if cosine(e[2], embedding) > 0.92), None)
            kept[k] = alive if found is not None else [*alive, (at, event, embedding)][-3:]
            out.add((k, event, found))
    return out


@pytest.mark.parametrize("name", CASES)
def test_a_fold_over_a_table_equals_a_replay(spark, name):
    order, values, fold, schema, settings = CASES[name]
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {tuple(r) for r in state.folded(df, ["k"], order, values, fold, schema, *settings).collect()} == replay(rows, name)


@pytest.mark.parametrize("name", CASES)
def test_a_stream_equals_a_replay_over_batches_and_a_restart(spark, tmp_path, name):
    order, values, fold, schema, settings = CASES[name]
    rows = events(120)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(parts):
        for k, part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            found = folds.folded_stream(stream, ["k"], order, values, fold, schema, *settings)
            q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination(120)  # each part is a start anew, from the checkpoint

    run([(0, rows[:50]), (1, rows[50:65]), (2, rows[65:])])
    assert {tuple(r) for r in spark.read.schema(schema).parquet(out).collect()} == replay(rows, name)


def test_a_key_is_forgotten_after_its_time_to_live(spark, tmp_path):
    order, values, fold, schema, settings = CASES["cooldown"]
    at = lambda s: (float(s), START + datetime.timedelta(seconds=s))
    parts = [[("a", *at(0), 1, False, [1.0])], [("b", *at(5000), 2, False, [1.0])], [("b", *at(9000), 3, False, [1.0])], [("a", *at(9001), 4, False, [1.0])]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        found = folds.folded_stream(stream, ["k"], order, values, fold, schema, *settings, late="10 seconds", ttl_seconds=600)
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()}
    assert ("a", 4, 1) in got and ("a", 1, 1) in got  # the second time it counts from one again


def test_ingestion_survives_a_cut_between_write_and_mark(spark, tmp_path):
    sink = ingest.Sink(f"{tmp_path}/table", ["id"], "version")
    batch = lambda *rows: spark.createDataFrame(rows, "id long, version long, text string")
    sink.upsert(batch((1, 1, "a"), (2, 1, "b"), (2, 2, "b2")), 0)
    told = lambda: sorted((r["id"], r["text"]) for r in sink.read(spark).collect())
    assert told() == [(1, "a"), (2, "b2")]
    cut_off = batch((1, 5, "new"), (3, 1, "c"))
    sink.write(cut_off, 1)  # and no mark
    assert told() == [(1, "a"), (2, "b2")]
    sink.upsert(cut_off, 1)
    sink.upsert(cut_off, 1)
    assert told() == [(1, "new"), (2, "b2"), (3, "c")]
    sink.upsert(batch((1, 2, "late"), (3, 1, "same version, later batch")), 2)
    assert told() == [(1, "new"), (2, "b2"), (3, "same version, later batch")]


def test_ingestion_as_a_stream(spark, tmp_path):
    sink = ingest.Sink(f"{tmp_path}/table", ["id"], "version")
    rows = [(k % 7, k, f"t{k}") for k in range(40)]
    for part in (rows[:15], rows[15:40]):
        spark.createDataFrame(part, "id long, version long, text string").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, version long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        sink.start(stream, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["id"], r["version"]) for r in sink.read(spark).collect()) == sorted((k, max(v for i, v, _ in rows if i == k)) for k in range(7))
    assert sink.read(spark).select(F.count("*")).first()[0] == 7
