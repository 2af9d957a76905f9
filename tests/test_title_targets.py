"""Targets by title where many rows share titles: each pair of titles is compared once, and results are those of all pairs."""

import difflib
import random

from pyspark.sql import functions as F

from palimpsest.functions import likeness
from palimpsest.plans import clusters


def test_targets_are_those_of_all_pairs_and_titles_meet_once(spark, monkeypatch):
    rng = random.Random(6)
    titles = ["large ring", "large rings", "hot bolt", "hot blot", "", None, "bolt ring", "a ring large"]
    rows = [(k, f"t{rng.randrange(2)}" if k % 40 else None, rng.randrange(2), rng.choice(titles), rng.choice(["x", "y", None])) for k in rng.sample(range(5000), 400)]
    compared = spark.sparkContext.accumulator(0)
    plain = likeness.ratio

    def counted(a, b):
        return plain(F.udf(lambda s: (compared.add(1), s)[1])(a), b)

    monkeypatch.setattr(likeness, "ratio", counted)
    df = spark.createDataFrame(rows, "id long, p_type string, p_size int, title string, place string").repartition(4)
    got = sorted((r["proposal"], r["note"], r["score"]) for r in clusters.title_targets(df, ["p_type", "p_size"], 3).collect())
    want = []
    words = lambda s: set((s or "").split()) - {"a"}
    for i, kind, size, title, place in rows:
        found = []
        for j, kind2, size2, title2, place2 in rows:
            if i != j and kind is not None and (kind, size) == (kind2, size2):
                x, y = title or "", title2 or ""
                both = words(x) & words(y)
                like = max(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), 0.6 * len(both) / max(1, len(words(x) | words(y))))
                score = round(like + (0.2 if place is not None and place == place2 else 0.0) + 1e-12, 4)
                if score >= clusters.LIKE:
                    found.append((i, j, score))
        want += sorted(found, key=lambda m: (-m[2], m[1]))[:3]
    assert got == sorted(want)
    assert 0 < compared.value <= 2 * len(titles) ** 2  # 80,000 pairs of rows
