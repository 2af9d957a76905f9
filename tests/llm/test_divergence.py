"""The divergence audit against plain code."""

import re
from collections import Counter

import pytest

from palimpsest.llm import divergence
from palimpsest.llm.queries import queries

from .conftest import SF

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, shown=50):
    """docs: (text, lang, source) rows."""
    rows = [((t or ""), (g or ""), (s or "")) for t, g, s in docs]
    out = set()
    for lang in {g for _, g, _ in rows}:
        df, of, own = Counter(), Counter(), {}
        for t, g, s in rows:
            if g == lang:
                terms = [x.translate(LOWER) for x in TERM.findall(t)]
                df.update(set(terms))
                of.update(terms)
                own.setdefault(s, Counter()).update(terms)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)

        def shares(n, kept=kept, v=v):
            whole = sum(n[x] for x in kept)
            return {t: 1 + 10**9 * (n[t] + 5) // (whole + 5 * v) for t in kept}

        q, p = shares(of), {s: shares(n) for s, n in own.items()}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:shown])):
                out |= {(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def plain(df):
    return [tuple(r) for r in df.select("text", "lang", "source").collect()]


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
@pytest.mark.parametrize("least", [1, 30])
def test_equals_plain_code(request, which, least):
    df = request.getfixturevalue(which)
    assert got(divergence.audit(df, least)) == brute(plain(df), least)


def test_op12_is_the_whole_table(spark):
    assert got(queries()["op12_divergence"](spark, SF)) == brute(plain(spark.read.parquet(f"{SF}/documents.parquet")), 30)


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_tiles_slices_and_small_batches(spark, tile):
    rows = [(f"w{k % 7} w{k % 5} common Common Été a{k % 11}b", "en" if k % 4 else None, f"s{k % 9}" if k % 13 else None) for k in range(200)]
    df = spark.createDataFrame([*rows, *rows[:20], ("", "xx", "alone"), (None, "xx", "other"), (None, "yy", None)], "text string, lang string, source string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert got(divergence.audit(df, 3, 5, tile=tile)) == brute(plain(df), 3, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_texts_are_read_in_stretches(monkeypatch):
    text = ("Ab cé " * 50 + "x" * 300 + " end").encode()
    whole = text.translate(divergence.LETTERS).split()
    for step in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(divergence, "STRETCH", step)
        assert [t for some in divergence.stretches(text) for t in some] == whole


def test_runs_sent_in_pieces(spark, docs, monkeypatch):
    want = brute(plain(docs), 30)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert got(divergence.audit(docs, 30)) == want


def test_counts_beyond_64_bits(spark):
    big = 9 * 10**18
    row = spark.range(1).select(divergence.share(divergence.F.lit(big), divergence.F.lit(big), divergence.F.lit(3)).alias("p"), divergence.share(divergence.F.lit(0), divergence.F.lit(0), divergence.F.lit(0)).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (big + 5) // (big + 15) and row["none"] is None
