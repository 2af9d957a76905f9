"""What decides, after retrieval, which hits come first: order of sources, boosts, penalties by rule, authority, keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import edged, lowered

#: Collections whose rows share coarse paths, so that a row's id tells it better.
LEARNED = ("semantic", "experience", "patterns")
#: How far the older of two statements that contradict each other falls, and what a primary document gains.
STALE_PENALTY, PRIMARY_BOOST = 160.0, 35.0


def fusion_key(collection: Column, id_: Column, path: Column, title: Column) -> Column:
    """What rows of several lists are told to be the same by."""
    learned = F.lower(collection).isin(*LEARNED) & id_.isNotNull()
    return F.when(learned, id_.cast("string")).otherwise(F.coalesce(path, id_.cast("string"), title, F.lit("")))


def diversified(ranked: DataFrame, window: int = 5, most: int = 2) -> DataFrame:
    """ranked (qid, id, source, rank from 1) -> the same with `place`: while the first `window` places aren't filled, a
    source's rows beyond `most` go to the very end; nothing is dropped.

    Until the window is full only rows within their source's share are chosen, so a row's place follows from how many such
    rows come before it: two running counts, no loop.
    """
    of_source = Window.partitionBy("qid", "source").orderBy("rank")
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    over = (F.col("source") != "") & (F.row_number().over(of_source) > most)
    marked = ranked.withColumn("_over", F.coalesce(over, F.lit(False)))
    chosen = F.coalesce(F.sum(F.when(F.col("_over"), 0).otherwise(1)).over(before), F.lit(0))
    marked = marked.withColumn("_late", F.col("_over") & (chosen < window))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("_late", "rank"))
    return marked.withColumn("place", place).drop("_over", "_late")


def metadata_boost(overlap: Column, infra: Column, code: Column, canonical: Column, collection: Column, primary: Column) -> Column:
    """Overlap of the question with what is told about a row, and factors by what the question is after."""
    boost = F.when(overlap > 0, F.least(F.lit(1.35), 1 + 0.45 * overlap)).otherwise(1.0)
    knows = F.when(infra & (collection == "knowledge"), F.when(primary, 1.45).otherwise(1.15)).otherwise(1.0)
    codes = F.when(infra & (collection == "code") & ~code, 0.68).otherwise(1.0) * F.when(infra & (collection == "experience"), 0.88).otherwise(1.0)
    canon = F.when(canonical & collection.isin("canonical", "distilled"), 1.35).otherwise(1.0) * F.when(canonical & (collection == "code") & ~code, 0.8).otherwise(1.0)
    return boost * knows * codes * canon


def source_boost(terms: Column, source: Column, service: Column) -> Column:
    """terms: the question's words of three or more letters. 0.45 if one names the service or a step of the path, 0.15 if
    one is part of the path."""
    strong = F.exists(terms, lambda t: source.contains(F.concat(F.lit("/"), t, F.lit("/"))) | source.contains(F.concat(F.lit("/"), t, F.lit("."))) | (t == service))
    return F.when(strong, 0.45).when(F.exists(terms, lambda t: source.contains(t)), 0.15).otherwise(0.0)


@dataclass(frozen=True)
class Rule:
    """A reason, when it holds (an expression over a row), and what it adds to the score."""

    reason: str
    when: str
    delta: float


def governed(rows: DataFrame, rules: Sequence[Rule], score: str = "score") -> DataFrame:
    """rows with score changed by all rules that hold, and `reasons`, theirs in order: a table of rules, one projection."""
    holds = [F.coalesce(F.expr(r.when), F.lit(False)) for r in rules]
    total = F.col(score)
    for h, r in zip(holds, rules, strict=True):
        total = total + F.when(h, r.delta).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(h, F.lit(r.reason)) for h, r in zip(holds, rules, strict=True)]))
    return rows.withColumn("reasons", reasons).withColumn(score, total)


def authority_tier(obsolete: Column, durable: Column, quoted: Column, episodic: Column, derived: Column) -> Column:
    return F.when(obsolete, "obsolete").when(durable, "direct").when(quoted, "quote").when(episodic, "episodic").when(derived, "derived").otherwise("curated")


def note_score(score: Column, title_overlap: Column, overlap: Column, trust: Column, asked: Column) -> Column:
    """A note's score as 0 to 100, less if its title and summary hold little of the question."""
    scaled = F.least(score, F.lit(200.0)) / 200 * 100
    penalty = F.when(asked & (title_overlap == 0) & (overlap < 0.5), 0.2).when(asked & (overlap < 0.3), 0.5).otherwise(1.0)
    return F.round(scaled * penalty * trust, 2)


#: Particles that a Korean word may end with, longest first.
PARTICLES = "에서는 에게서 에서도 으로는 에서 에게 에는 으로 이나 까지 부터 한테 이랑 라고 처럼 보다 마다 조차 마저 밖에 께서 은 는 이 가 을 를 와 과 의 도 에 로 만 랑".split()


def stem(token: Column) -> Column:
    """A Korean word without its particle, if two syllables at least are left; any other word as it is."""
    found = F.regexp_extract(token, f"({'|'.join(PARTICLES)})$", 1)
    for p in reversed(PARTICLES):  # the longest that fits, though a shorter one may leave more
        found = F.when(token.endswith(p) & (F.length(token) > len(p)), F.lit(p)).otherwise(found)
    left = F.length(token) - F.length(found)
    return F.when(token.rlike("^[가-힣]") & (F.length(found) > 0) & (left >= 2), F.substring(token, F.lit(1), left)).otherwise(token)


#: Words that negate what follows within three words.
CUES = "not never nor isnt arent wasnt werent dont doesnt didnt cant cannot wont couldnt wouldnt shouldnt aint".split()


def has_unnegated(text: Column, pattern: str) -> Column:
    """Whether the pattern (without groups) is met anywhere with no negation among the three words before it; its edges of
    words are ASCII's."""
    gaps = F.split(F.regexp_replace(lowered(text), "['’]", ""), edged(pattern), -1)
    words = lambda gap: F.regexp_extract_all(gap, F.lit("[a-z0-9]+|[가-힣]+"), F.lit(0))
    last = lambda gap: F.slice(F.reverse(words(gap)), 1, 3)
    cues = F.array(*map(F.lit, CUES))
    return F.exists(F.slice(gaps, 1, F.size(gaps) - 1), lambda gap: ~F.arrays_overlap(last(gap), cues))
