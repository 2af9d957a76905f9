"""Each stage on what the stage before it kept, on whole tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import secrets

from .conftest import SF
from .test_text_operators import base_spans, brute_fingerprint


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["docs", "odd", "empty"])
def steps(request, spark):
    docs = request.getfixturevalue(request.param)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_keep_columns(steps):
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert after.columns == before.columns
    assert steps[5].columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_language_keeps_clean_documents(steps):
    kept = {t for _, t in texts(steps[1])}
    assert all(t in kept for _, t in texts(steps[0]) if t and len(t) > 40 and any(c.isalpha() for c in t) and not t.startswith(("w w", "x0")))
    assert None not in kept


def test_one_of_each_component_stays(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert {d for d, _ in after} <= {d for d, _ in before}
    fps = [brute_fingerprint(t) for _, t in after]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    kept = [brute_fingerprint(t) for _, t in after]
    reachable = list(kept)
    left = {brute_fingerprint(t) for d, t in before if d is not None}
    while near := {f for f in left if any((f ^ r).bit_count() <= 4 for r in reachable)}:
        left -= near
        reachable = list(near)
    assert not left


def test_secrets_are_gone_and_others_untouched(steps):
    before, after = dict(texts(steps[2])), dict(texts(steps[3]))
    assert set(before) == set(after)
    changed = {d for d in before if before[d] != after[d]}
    assert {d for d in before if base_spans(before[d])} <= changed
    assert not [d for d in after if base_spans(after[d])]
    paths, _ = secrets.scan(steps[2])
    assert changed == {r["path"] for r in paths.where(F.size("spans") > 0).collect()}


def test_the_mix_holds_first_words(steps):
    before, after = dict(texts(steps[3])), texts(steps[4])
    assert all(before[d].startswith(t) for d, t in after)
    assert max(Counter(d for d, _ in after).values(), default=0) <= 2
    words = sum(len(t.encode().split()) for _, t in after)
    assert abs(words - 1.5 * sum(len((t or "").encode().split()) for t in before.values())) <= 0.01 * words + 20


def test_everything_is_packed(steps):
    assert Counter(r["doc_id"] for r in steps[5].where("piece = 0").collect()) == Counter(d for d, _ in texts(steps[4]))


def test_run_does_what_the_stages_do(spark, docs):
    """All pieces of what the fourth stage leaves, each once; the mix is the same on every run."""
    before = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        before = stage(spark, before, SF)
    want = Counter(d for d, _ in texts(before))
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).where("piece = 0").collect()) == want


def test_the_mix_comes_in_the_order_of_the_schedule(steps, spark):
    """Any stretch of the mix's rows holds the sources near their weights, so a source's rows are spread over all of it."""
    order = [r["source"] for r in steps[4].collect()]
    if len(order) < 100:
        return
    for name, n in Counter(order).items():
        places = [k for k, s in enumerate(order) if s == name]
        if n >= 20:
            assert min(places) < len(order) / 4 and max(places) > 3 * len(order) / 4
