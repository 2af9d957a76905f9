"""Search over many collections and sources, for all questions at once.

Candidates of each collection by vectors, scored with words and the source's signal; lists of several sources, weighed by
what a question is after; the newest matches elsewhere. Rows with a null id or vector are no candidates; questions without
words get what vectors find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.vector import dot, norm
from palimpsest.operators import fusion, joins, retrieval

C = F.col
#: Candidates of a collection: so many, or so many times what is asked for.
LEAST_CANDIDATES, TIMES = 25, 3


def collections_search(questions: DataFrame, documents: DataFrame, limit: int, signal: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """questions (qid, text, vector; several rows of a qid are variants, of which the first by text has the words), documents
    (id, collection, path, text, vector) -> qid, id, collection, score, rank: the best `limit` of a question over all
    collections, each text once. `signal` makes a source's from the question's tokens, collection and path; without one
    only vectors and words count. Each variant has candidates of its own in each collection; words are looked at in
    candidates only. Of equal texts the best counts, of equal scores the smaller id."""
    most = max(LEAST_CANDIDATES, TIMES * limit)
    asked = questions.where("qid IS NOT NULL AND vector IS NOT NULL").select("qid", F.xxhash64("text", "vector").alias("variant"), C("vector").alias("_q"), norm(C("vector")).alias("_qn"))
    points = documents.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "collection", C("vector").alias("_p"), norm(C("vector")).alias("_pn"))
    sizes = C("_qn") * C("_pn")
    likeness = F.round(F.when(sizes == 0, 0.0).otherwise(dot(C("_q"), C("_p")) / sizes), 4)
    met = joins.each_with_each(asked, points).select("qid", "variant", "collection", "id", likeness.alias("vector"))
    near = joins.top_k(met, ["qid", "variant", "collection"], [F.desc("vector"), C("id")], most)
    near = near.groupBy("qid", "collection", "id").agg(F.max("vector").alias("vector"))
    held = documents.join(near.select("id", "collection").distinct(), ["id", "collection"], "left_semi")
    held = held.select("id", "collection", "path", text.tokens(C("text")).alias("d"), F.md5(F.coalesce("text", F.lit(""))).alias("same"))
    words = questions.groupBy("qid").agg(F.min("text").alias("text")).select("qid", text.tokens(F.coalesce("text", F.lit(""))).alias("q"))
    both = near.join(held, ["id", "collection"]).join(words, "qid")
    of_source = signal(C("q"), C("collection"), C("path")) if signal else F.lit(0.0)
    blend = retrieval.hybrid_blend(F.greatest(F.lit(0.0), C("vector")), F.coalesce(text.coverage(C("q"), C("d")), F.lit(0.0)), of_source)
    scored = both.select("qid", "id", "collection", "same", F.round(blend, 4).alias("score"))
    once = joins.top_k(scored, ["qid", "same"], [F.desc("score"), C("id"), C("collection")], 1).drop("rank", "same")
    return joins.top_k(once, ["qid"], [F.desc("score"), C("id")], limit)


#: A source's weight, and the factor of a question's intent that it is multiplied with.
SOURCES = {
    "rag": (0.9, "rag"),
    "canonical": (1.0, "canonical"),
    "obsidian": (0.6, None),
    "graph": (0.5, "graph"),
    "fts": (0.4, None),
    "graph_prefetch": (0.7, "graph"),
    "raptor": (0.85, "canonical"),
    "sessions": (0.30, None),
}


def factors(question: Column) -> list[Column]:
    """graph, rag, canonical: what a question's intent makes of them."""
    name = retrieval.intent(question)
    return [retrieval.intent_weight(name, k).alias(n) for k, n in enumerate(("graph", "rag", "canonical"))]


def composed(lists: DataFrame, questions: DataFrame, sources: dict[str, tuple[float, str | None]] = SOURCES, factors_of: Callable[[Column], list[Column]] = factors) -> DataFrame:
    """lists (qid, id, source, rank from 0), questions (qid, text) -> qid, id, score from 0 to 100. Lists without a row don't
    count in what could be reached; sources that have no weight here are left out."""
    weight = F.lit(None).cast("double")
    for source, (base, by) in sources.items():
        weight = F.when(C("source") == source, base * C(by) if by else F.lit(base)).otherwise(weight)
    of = questions.select("qid", *factors_of(F.coalesce("text", F.lit(""))))
    return fusion.weighed(lists.join(of, "qid").select("qid", "id", "source", "rank", weight.alias("weight")).where("weight IS NOT NULL"))


#: Words of a question that are looked for, how many of the newest matches are gone through, and how many come back.
WORDS, NEWEST, MOST_ANALOGS = 12, 200, 5
SETTLED = ("refined", "accepted", "superseded")


def asked_words(column: Column) -> Column:
    found = F.regexp_extract_all(F.lower(column), F.lit(r"([a-z0-9_]{3,})"), F.lit(1))
    return F.array_distinct(F.slice(found, 1, WORDS))


def analogs(questions: DataFrame, events: DataFrame, now: Column, limit: int = MOST_ANALOGS, days: int = 180) -> DataFrame:
    """questions (qid, text, repo), events (id, repo, text, outcome, ts) -> qid, repo, id, outcome, ts, rank: the newest settled
    event of each other repository among the NEWEST that have a word of the question, newest first; ties to the greater
    id. Of a word only its NEWEST events can be among a question's, so no more are kept of it, before anything is
    joined; that is exact. Events without a repository or time are left out."""
    asked = questions.select("qid", C("repo").alias("own"), F.explode(asked_words(F.coalesce("text", F.lit("")))).alias("word"))
    live = events.where(C("outcome").isin(*SETTLED)).where(C("ts") > now - F.make_interval(days=F.lit(days))).where("coalesce(repo, '') <> ''")
    held = live.select("id", "repo", "outcome", "ts", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]{3,})"), F.lit(1)))).alias("word"))
    held = held.join(asked.select("word").distinct(), "word", "left_semi")
    newest = [F.desc("ts"), F.desc("id")]
    postings = joins.top_k(held, ["word"], newest, NEWEST).drop("rank")
    found = asked.join(postings, "word").select("qid", "own", "repo", "id", "outcome", "ts").distinct()
    found = joins.top_k(found, ["qid"], newest, NEWEST).drop("rank").where("NOT repo <=> own")
    return joins.top_k(joins.top_k(found, ["qid", "repo"], newest, 1).drop("rank"), ["qid"], newest, limit).drop("own")
