"""Set joins against all pairs; time expressions as columns against their definition; decomposed words."""

import datetime
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import intervals, text, timewords
from palimpsest.operators import setjoin


def sets(n=240, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        base = rng.choice([[f"r{g}_{x}" for x in range(8)] for g in range(25)])
        own = [w for w in base if rng.random() < 0.8] + [f"c{rng.randrange(6)}" for _ in range(rng.randrange(3))] + [f"u{k}_{x}" for x in range(rng.randrange(3))]
        out.append((k, own, f"s{k % 3}"))
    return out + [(1000 + k, ["r0_1", "r0_2", "r0_3"], "s0") for k in range(40)] + [(2000, [], "s0"), (2001, None, "s0"), (2002, [], "s0"), (2003, ["only"], None)]


@pytest.mark.parametrize("like", setjoin.LIKE)
@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_pairs_equal_all_pairs(spark, like, least):
    rows = sets()
    df = spark.createDataFrame(rows, "id long, tokens array<string>, source string").repartition(4)
    members, pairs = setjoin.alike(df, least, like, ("source",))
    got = [tuple(r) for r in setjoin.pairs_of_ids(members, pairs).collect()]
    assert len(got) == len(set(got))
    want = set()
    held = [(k, set(x), s) for k, x, s in rows if x and s is not None]
    for i, (a, x, s) in enumerate(held):
        for b, y, z in held[i + 1 :]:
            both = len(x & y)
            if s == z and both / (len(x | y) if like == "jaccard" else min(len(x), len(y))) >= least:
                want.add((min(a, b), max(a, b)))
    assert set(got) == want


@pytest.mark.parametrize("slice_", [9, 4096])
@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_pairs_within_a_key_without_rows_of_words(spark, least, slice_):
    rows = sets()
    df = spark.createDataFrame(rows, "id long, tokens array<string>, source string").withColumn("n", F.col("id") * 2).repartition(4)
    found = setjoin.alike_within(df, "source", least, ("n",), slice_)
    got = [tuple(r) for r in found.collect()]
    held = [(k, set(x), s) for k, x, s in rows if x and s is not None]
    want = [(min(a, b), max(a, b)) for i, (a, x, s) in enumerate(held) for b, y, z in held[i + 1 :] if s == z and len(x & y) / len(x | y) >= least]
    assert sorted(got) == sorted((a, b, 2 * a, 2 * b) for a, b in want)
    assert "explode(tokens" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("stretch", [7, 2000])
def test_sets_like_one_of_the_recent(spark, stretch):
    rows = sets()
    got = [r["id"] for r in setjoin.like_recent(spark.createDataFrame(rows, "id long, tokens array<string>, source string").repartition(3), "source", 5, 0.5, stretch).collect()]
    want = []
    for s in ("s0", "s1", "s2"):
        own = sorted((k, set(x or ())) for k, x, z in rows if z == s)
        for n, (k, x) in enumerate(own):
            if any(x and y and len(x & y) / len(x | y) >= 0.5 for _, y in own[max(0, n - 5) : n]):
                want.append(k)
    assert sorted(got) == sorted(want)


def test_few_pairs_are_looked_at(spark):
    rows = [(k, x, s) for k, x, s in sets(600, 9) if x and k < 1000]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, source string")
    whole = setjoin.classes(df, []).where("id = of").withColumn("n", F.size("tokens"))
    n, met = whole.count(), setjoin.candidates(whole, [], 0.8, "jaccard").count()
    assert met < 0.05 * n * (n - 1) / 2


def expressions(rng):
    units = [u for u in intervals.UNIT_DAYS if u not in ("h", "hour", "hours")]
    fixed = ["now", "Today", "yesterday", "tomorrow", "this week", "LAST  week", "this month", "last month", "this year", "last year", "nonsense", "", "  ", "5 parsecs", "days ago", "2024-02-30", "2024-13-01", "last", "2024-05-06", "2024-05-06T07:08:09", "2024-05-06 07:08", "2024-05-06T07:08:09Z", "2024-05-06T07:08:09+02:00"]
    return fixed + [f"{p}{d}" for d in intervals.DAYS for p in ("", "last ")] + [f"{rng.randrange(500)}{rng.choice(['', ' '])}{rng.choice(units)}{rng.choice(['', ' ago'])}" for _ in range(60)]


def test_time_expressions_equal_their_definition(spark):
    rng = random.Random(3)
    nows = [datetime.datetime(2024, 2, 29, 13, 14, 15, 123456), datetime.datetime(2025, 1, 1), datetime.datetime(2023, 12, 31, 23, 59, 59)]
    rows = [(x, now) for x in expressions(rng) for now in nows] + [(None, nows[0])]
    df = spark.createDataFrame(rows, "x string, now timestamp").select("x", "now", timewords.span(F.col("x"), F.col("now")).alias("s")).select("x", "now", "s.*")
    for r in df.collect():
        assert (r["since"], r["until"]) == intervals.span(r["x"], r["now"]), r["x"]
    assert df.where("since IS NOT NULL").count() > 150


def test_what_a_text_speaks_of(spark):
    now = datetime.datetime(2025, 1, 15, 9, 30)
    texts = ["what did we do 3 days ago, and last week?", "Last Monday we met", "notes of 2024-05-06.", "this month so far", "nothing of the kind, weekdays and 33 daysago", "", None, "x" * 100_000 + " yesterday"]
    got = spark.createDataFrame([(k, t, now) for k, t in enumerate(texts)], "k int, t string, now timestamp").select("k", timewords.spoken_of(F.col("t"), F.col("now")).alias("s")).orderBy("k").collect()
    for r, t in zip(got, texts, strict=True):
        assert (tuple(r["s"]) if r["s"] else (None, None)) == intervals.intent(t or "", now)


def test_sparse_words_of_all_letters_with_marks(spark):
    letters = [chr(c) for c in range(0xC0, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c)) and chr(c).isalpha()]
    rows = [(k, f"Zx{c}b  zwei_{c.upper()}") for k, c in enumerate(letters)] + [(-1, None), (-2, ""), (-3, "the and of Plain words plain")]
    got = dict(spark.createDataFrame(rows, "k long, t string").select("k", text.sparse_tokens(F.col("t"))).collect())
    assert got[-1] is None and got[-2] == [] and got[-3] == ["plain", "words", "plain"]
    for k, t in rows[: len(letters)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
        assert got[k] == [w for w in re.findall(r"\w+", bare) if w not in text.STOPWORDS]
    assert len(letters) > 900
