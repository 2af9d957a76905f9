"""Queries over many collections and sources, for all questions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.temporal import age_days
from palimpsest.operators import fusion, graph, joins, multisource, retrieval, runs
from palimpsest.operators.graph import cut, shared
from palimpsest.plans.bindings import ATOMS, AUDIT, EDGES, NOW, atoms, audit, duck_jaccard, duck_tokens, edges, now_
from palimpsest.plans.governance import BROAD
from palimpsest.plans.joins import COS
from palimpsest.plans.lifecycle import VERDICT, conflict_actions
from palimpsest.plans.networks import NAME, named
from palimpsest.plans.registry import query
from palimpsest.plans.retrieval import INTENT_SQL, SECTION
from palimpsest.plans.windows import LISTS, ranked_lists

C = F.col
BROAD_SQL = "(len(regexp_extract_all(text, '\\S+')) > 4 OR " + " OR ".join(f"contains(lower(text), '{w}')" for w in BROAD) + ")"


def of_intent(source: int) -> str:
    return "CASE intent " + " ".join(f"WHEN '{n}' THEN {w[source]}" for n, _, w in retrieval.INTENTS) + " ELSE 1.0 END"


def weight_sql() -> str:
    by = {"graph": 0, "rag": 1, "canonical": 2}
    return "CASE source " + " ".join(f"WHEN '{s}' THEN {w} * {of_intent(by[k]) if k else '1.0'}" for s, (w, k) in multisource.SOURCES.items()) + " END"


def first(name: str, of: str, order: str, n: int) -> str:
    return f"SELECT qid, id, '{name}' AS source, row_number() OVER (PARTITION BY qid ORDER BY {order}) - 1 AS rank FROM {of} QUALIFY rank < {n}"


#: Rows of each source's list.
LENGTHS = {"rag": 30, "canonical": 10, "obsidian": 10, "graph": 5, "fts": 20, "graph_prefetch": 10, "raptor": 3, "sessions": 10}

ALL_SOURCES = f"""
{ATOMS}, {EDGES}, q AS (SELECT item_id AS qid, {duck_tokens('text')} AS q, {INTENT_SQL} AS intent, {BROAD_SQL} AS broad FROM benchmark),
i AS (SELECT concat('d', id) AS id, collection, {duck_tokens('text')} AS d FROM atoms UNION ALL SELECT concat('c', conv_id, '-', turn), 'sessions', {duck_tokens('text')} FROM conversations),
s AS (SELECT qid, id, collection, round({duck_jaccard('q', 'd')}, 6) AS j, round(CAST(len(list_intersect(q, d)) AS DOUBLE) / len(q), 6) AS v FROM q, i WHERE list_has_any(q, d)),
near AS (SELECT a.vec_id AS v, b.vec_id AS other, concat('d', b.vec_id) AS id, round({COS}, 4) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
rag AS (SELECT v AS qid, near.id, c FROM near JOIN q ON v = qid JOIN atoms ON atoms.id = other WHERE kind <> 'raw_dump'),
w AS (SELECT DISTINCT qid, CAST(('0x' || md5(w)[1:8]) AS BIGINT) % (SELECT count(*) FROM customer) + 1 AS node FROM (SELECT qid, unnest(q) AS w FROM q) WHERE length(w) >= {NAME}),
g AS (SELECT *, concat('d', k) AS id FROM (SELECT qid, -1 - dst AS k, max(edges.w) AS best FROM w JOIN edges ON src = node GROUP BY qid, dst) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY best DESC, k) <= {LENGTHS['graph']}),
p AS (SELECT qid, near.id, max(c) AS c FROM g JOIN (SELECT * FROM near WHERE v IN (SELECT k FROM g) QUALIFY row_number() OVER (PARTITION BY v ORDER BY c DESC, other) <= 2) near ON v = k GROUP BY ALL),
e AS (SELECT vec_id, embedding, unnest([{{'level': 1, 'node': label}}, {{'level': 2, 'node': label // 4}}], recursive := true) FROM embeddings),
me AS (SELECT level, node, list(m ORDER BY i) AS m FROM (SELECT level, node, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM e, range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL),
su AS (SELECT DISTINCT summary FROM (SELECT level, node, arg_max(vec_id, row(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), m), 5), -vec_id)) AS summary FROM e JOIN me USING (level, node) GROUP BY ALL)),
r AS (SELECT qid, near.id, c FROM q JOIN near ON v = qid JOIN su ON summary = other WHERE broad),
l AS ({first('rag', 'rag', 'c DESC, id', 30)} UNION ALL {first('canonical', "(FROM s WHERE collection = 'canonical')", 'v DESC, id', 10)} UNION ALL {first('obsidian', "(FROM s WHERE collection = 'obsidian')", 'v DESC, id', 10)}
UNION ALL {first('sessions', "(FROM s WHERE collection = 'sessions')", 'v DESC, id', 10)} UNION ALL {first('fts', "(FROM s WHERE collection <> 'sessions')", 'j DESC, id', 20)} UNION ALL {first('graph', 'g', 'best DESC, k', 5)}
UNION ALL {first('graph_prefetch', 'p', 'c DESC, id', 10)} UNION ALL {first('raptor', 'r', 'c DESC, id', 3)}),
k AS (SELECT l.*, {weight_sql()} AS weight FROM l JOIN q USING (qid)), den AS (SELECT qid, sum(weight) / 60 AS den FROM (SELECT DISTINCT qid, source, weight FROM k) GROUP BY qid),
f AS (SELECT qid, id, sum(weight / (60 + rank)) AS s FROM k GROUP BY ALL),
o AS (SELECT qid, id, least(100, greatest(0, 100 * s / den)) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s / den, 9) DESC, id) AS rank FROM f JOIN den USING (qid))
"""


def source_lists(t):
    """qid, id, source, rank from 0: eight lists of every question over whole tables. Documents are `d` and their number,
    what was said in conversations `c` and its place. A node's memory is the document of its number."""
    questions = t.benchmark.select(C("item_id").alias("qid"), "text")
    asked = t.embeddings.join(questions.select(C("qid").alias("vec_id")), "vec_id", "left_semi")
    doc = lambda c: F.concat(F.lit("d"), C(c).cast("string")).alias("id")

    # words: one pass over the pairs that share one
    docs = atoms(t).select(F.struct("collection", doc("id")).alias("id"), text.tokens(C("text")).alias("d"))
    said = t.conversations.select(F.struct(F.lit("sessions").alias("collection"), F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id")).alias("id"), text.tokens(C("text")).alias("d"))
    shared = retrieval.shared_tokens(questions.select("qid", text.tokens(C("text")).alias("q")), docs.unionByName(said))
    j, v = F.round(C("n") / (C("nq") + C("nd") - C("n")), 6), F.round(C("n") / C("nq"), 6)
    named_list = F.when(C("id.collection").isin("canonical", "obsidian", "sessions"), F.struct(C("id.collection").alias("source"), v.alias("score")))
    fts = F.when(C("id.collection") != "sessions", F.struct(F.lit("fts").alias("source"), j.alias("score")))
    words = shared.select("qid", C("id.id").alias("id"), F.explode(F.array_compact(F.array(named_list, fts))).alias("x")).select("qid", "id", "x.source", "x.score")

    # vectors: each question against all of them
    plain = t.embeddings.join(atoms(t).where("kind <> 'raw_dump'").select(C("id").alias("vec_id")), "vec_id", "left_semi")
    rag = joins.nearest_vectors(plain, asked, LENGTHS["rag"]).select("qid", doc("id"), F.lit("rag").alias("source"), C("cosine").alias("score"))
    tree = graph.summary_tree(t.embeddings.select(C("vec_id").alias("id"), "embedding", "label"), [C("label"), F.floor(C("label") / 4)])
    summaries = t.embeddings.join(tree.select(C("summary").alias("vec_id")).distinct(), "vec_id", "left_semi")
    wide = F.regexp_count("text", F.lit(r"\S+")) > 4
    for word in BROAD:
        wide = wide | F.lower("text").contains(word)
    broad = asked.join(questions.where(wide).select(C("qid").alias("vec_id")), "vec_id", "left_semi")
    raptor = joins.nearest_vectors(summaries, broad, LENGTHS["raptor"]).select("qid", doc("id"), F.lit("raptor").alias("source"), C("cosine").alias("score"))

    # the graph: what a question's entities are strongest tied to, and what is like that
    near = named(t, questions, "qid").join(edges(t).select(C("src").alias("node"), (-1 - C("dst")).alias("k"), "w"), "node")
    near = joins.top_k(near.groupBy("qid", "k").agg(F.max("w").alias("score")), ["qid"], [F.desc("score"), C("k")], LENGTHS["graph"])
    tied = near.select("qid", doc("k"), F.lit("graph").alias("source"), (C("rank") - 1).alias("rank"))
    around = t.embeddings.join(near.select(C("k").alias("vec_id")), "vec_id", "left_semi")
    like = joins.nearest_vectors(t.embeddings, around, 2).select(C("qid").alias("k"), doc("id"), "cosine")
    prefetch = near.join(like, "k").groupBy("qid", "id").agg(F.max("cosine").alias("score")).select("qid", "id", F.lit("graph_prefetch").alias("source"), "score")

    most = F.lit(0)
    for source, n in LENGTHS.items():
        most = F.when(C("source") == source, n).otherwise(most)
    every = words.unionByName(rag).unionByName(raptor).unionByName(prefetch)
    ranked = joins.top_k(every, ["qid", "source"], [F.desc("score"), C("id")], max(LENGTHS.values())).where(C("rank") <= most)
    return ranked.select("qid", "id", "source", (C("rank") - 1).alias("rank")).unionByName(tied)


@query("set_sources", f"WITH {ALL_SOURCES} SELECT qid, id, round(score, 2) AS score, rank FROM o WHERE rank <= 10")
def set_sources(t):
    fused = multisource.composed(source_lists(t), t.benchmark.select(C("item_id").alias("qid"), "text"))
    top = joins.top_k(fused, ["qid"], [F.desc(F.round(C("score") / 100, 9)), C("id")], 10)
    return top.select("qid", "id", F.round("score", 2).alias("score"), C("rank").cast("long").alias("rank"))


@query("join_collections", f"WITH {ATOMS}, q AS (SELECT item_id AS qid, {duck_tokens('text')} AS q, embedding FROM benchmark JOIN embeddings ON vec_id = item_id), d AS (SELECT id, collection, md5(text) AS same, {duck_tokens('text')} AS d, embedding FROM atoms JOIN embeddings ON vec_id = id), n AS (SELECT qid, q, d, b.id, collection, same, round({COS}, 4) AS v FROM q a, d b QUALIFY row_number() OVER (PARTITION BY qid, collection ORDER BY v DESC, id) <= 30), s AS (SELECT *, CASE WHEN len(q) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, d)) AS DOUBLE) / len(q) END AS kw, greatest(0.0, v) AS x FROM n), m AS (SELECT qid, id, collection, same, round(least(1.0, greatest(0.0, CASE collection WHEN 'canonical' THEN 0.55 * x + 0.35 * kw + 0.10 * least(1.0, 0.2 / 0.45) WHEN 'personal' THEN 0.55 * x + 0.35 * kw + 0.10 * greatest(-0.2, -0.05 / 0.45) ELSE 0.61 * x + 0.39 * kw END)), 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid, same ORDER BY score DESC, id) = 1) SELECT qid, id, collection, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m QUALIFY rank <= 10")
def join_collections(t):
    """Every question, in all collections. A question's vector is that of its number; canonical notes are lifted, personal
    ones lowered."""
    vectors = t.embeddings.select(C("vec_id").alias("id"), C("embedding").alias("vector"))
    questions = t.benchmark.select(C("item_id").alias("id"), "text").join(vectors, "id").select(C("id").alias("qid"), "text", "vector")
    documents = atoms(t).select("id", "collection", "path", "text").join(vectors, "id")
    signal = lambda q, collection, path: F.when(collection == "canonical", 0.2).when(collection == "personal", -0.05).otherwise(0.0)
    return multisource.collections_search(questions, documents, 10, signal).withColumn("rank", C("rank").cast("long"))


OUTCOME = "CASE id % 4 WHEN 0 THEN 'refined' WHEN 1 THEN 'accepted' WHEN 2 THEN 'superseded' END"


@query("join_text_analogs", f"WITH {ATOMS}, q AS (SELECT item_id AS qid, concat('src', item_id % 20) AS own, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}')[1:12]) AS q FROM benchmark), e AS (SELECT id, path AS repo, {OUTCOME} AS outcome, created_at AS ts, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}')) AS x FROM atoms WHERE id % 4 < 3 AND created_at > {NOW} - INTERVAL 180 DAY), n AS (SELECT qid, own, repo, id, outcome, ts FROM q JOIN e ON list_has_any(q, x) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ts DESC, id DESC) <= 200), r AS (SELECT * FROM n WHERE repo <> own QUALIFY row_number() OVER (PARTITION BY qid, repo ORDER BY ts DESC, id DESC) = 1) SELECT qid, repo, id, outcome, ts, CAST(row_number() OVER (PARTITION BY qid ORDER BY ts DESC, id DESC) AS BIGINT) AS rank FROM r QUALIFY rank <= 5")
def join_text_analogs(t):
    """For every question, what was settled elsewhere about its words; sources stand for repositories."""
    questions = t.benchmark.select(C("item_id").alias("qid"), "text", F.concat(F.lit("src"), (C("item_id") % 20).cast("string")).alias("repo"))
    events = atoms(t).select("id", C("path").alias("repo"), "text", F.expr(OUTCOME).alias("outcome"), C("created_at").alias("ts"))
    return multisource.analogs(questions, events, now_()).withColumn("rank", C("rank").cast("long"))


RESOLUTIONS = (
    f"WITH {ATOMS}, {AUDIT}, x AS (SELECT *, {duck_tokens('text')} AS x FROM atoms), p AS (SELECT supersedes AS old_id, id AS new_id FROM atoms WHERE supersedes IS NOT NULL UNION SELECT id, superseded_by FROM atoms WHERE superseded_by IS NOT NULL), "
    f"m AS (SELECT old_id, new_id, {duck_jaccard('o.x', 'n.x')} AS j FROM p JOIN x o ON o.id = old_id LEFT JOIN x n ON n.id = new_id), pol AS (SELECT old_id, new_id, {VERDICT} AS policy FROM m JOIN atoms o ON o.id = old_id LEFT JOIN atoms n ON n.id = new_id), "
    "v AS (SELECT atom, CASE outcome WHEN 'right' THEN 'keep_new' WHEN 'wrong' THEN 'keep_old' ELSE 'merge' END AS vote, count(*) AS n FROM audit WHERE atom IS NOT NULL AND outcome IS NOT NULL GROUP BY ALL), w AS (SELECT atom, arg_max(vote, row(n, vote)) AS vote FROM v GROUP BY atom HAVING sum(n) >= 3 AND max(n) >= 2), "
    "a AS (SELECT old_id, new_id, coalesce(vote, policy) AS action, vote IS NOT NULL AS voted FROM pol LEFT JOIN w ON atom = new_id) SELECT old_id, new_id, CASE WHEN action IN ('merge', 'review') THEN 'pending' ELSE action END AS action, voted, CASE action WHEN 'keep_new' THEN old_id WHEN 'keep_old' THEN new_id END AS loser FROM a"
)


@query("state_resolutions", RESOLUTIONS)
def state_resolutions(t):
    """Votes on the new side first: three at least, two of them for what has most (of equals, the last by name). What they
    don't settle goes by the policy. Merging and reviewing wait for a person. `loser` is who is superseded."""
    vote = F.when(C("outcome") == "right", "keep_new").when(C("outcome") == "wrong", "keep_old").otherwise("merge")
    v = audit(t).where("atom IS NOT NULL AND outcome IS NOT NULL").groupBy(C("atom").alias("new_id"), vote.alias("vote")).agg(F.count("*").alias("n"))
    w = v.groupBy("new_id").agg(F.sum("n").alias("votes"), F.max("n").alias("most"), F.max_by("vote", F.struct("n", "vote")).alias("vote")).where("votes >= 3 AND most >= 2").select("new_id", "vote")
    a = conflict_actions(t).join(w, "new_id", "left").withColumn("voted", C("vote").isNotNull()).withColumn("action", F.coalesce("vote", "action"))
    loser = F.when(C("action") == "keep_new", C("old_id")).when(C("action") == "keep_old", C("new_id"))
    return a.select("old_id", "new_id", F.when(C("action").isin("merge", "review"), "pending").otherwise(C("action")).alias("action"), "voted", loser.alias("loser"))


TOP = f"{LISTS}, rk AS (SELECT qid, id, least(100, greatest(0, 100 * s / den)) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s / den, 9) DESC, id) AS rank FROM f JOIN den USING (qid))"


def top(t, n: int):
    fused = fusion.rrf(ranked_lists(t), {"jaccard": 0.9, "cover": 1.0})
    return joins.top_k(fused, ["qid"], [F.desc(F.round(C("score") / 100, 9)), C("id")], n)


def questions_words(t):
    return t.benchmark.select(C("item_id").alias("qid"), text.tokens(C("text")).alias("q"))


@query("rank_answers", f"WITH {ATOMS}, {TOP}, a AS (SELECT qid, {duck_jaccard('q', 'x')} AS j, confidence, greatest(0, 1 - (epoch({NOW}) - epoch(created_at)) / 86400 / 180) AS fresh FROM rk JOIN (SELECT *, {duck_tokens('text')} AS x FROM atoms) USING (id) JOIN (SELECT item_id AS qid, q FROM q) USING (qid) WHERE rank <= 3) SELECT qid, round(0.60 * max(j) + 0.25 * avg(confidence) + 0.15 * avg(fresh), 4) AS score FROM a GROUP BY qid")
def rank_answers(t):
    """How well each question's three best documents answer it: words, confidence, freshness."""
    docs = atoms(t).select("id", "confidence", "created_at", "text")
    a = top(t, 3).join(docs, "id").join(questions_words(t), "qid")
    fresh = F.greatest(F.lit(0.0), 1 - age_days(C("created_at"), now_()) / 180)
    return a.groupBy("qid").agg(F.round(0.60 * F.max(text.jaccard(C("q"), text.tokens(C("text")))) + 0.25 * F.avg("confidence") + 0.15 * F.avg(fresh), 4).alias("score"))


@query("rank_sections", f"WITH {TOP}, a AS (SELECT qid, id, round(0.7 * {duck_jaccard('q', 'x')} + 0.3 * least(1.0, score / 100), 6) AS score FROM rk JOIN (SELECT doc_id AS id, {duck_tokens(f'''concat(substr(text, 1, {SECTION}), ' ', source)''')} AS x FROM documents) USING (id) JOIN (SELECT item_id AS qid, q FROM q) USING (qid) WHERE rank <= 30) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM a WHERE score > 0.02")
def rank_sections(t):
    """Each question's thirty best sections by shared words and what they had before; a section is what the operator
    reads of a document."""
    d = t.documents.select(C("doc_id").alias("id"), F.concat(F.substring("text", 1, SECTION), F.lit(" "), "source").alias("s"))
    a = top(t, 30).join(d, "id").join(questions_words(t), "qid")
    score = F.round(0.7 * text.jaccard(C("q"), text.tokens(C("s"))) + 0.3 * F.least(F.lit(1.0), C("score") / 100), 6)
    kept = a.select("qid", "id", score.alias("score")).where("score > 0.02")
    return joins.top_k(kept, ["qid"], [F.desc("score"), C("id")], 30, "place").withColumn("place", C("place").cast("long"))


RUNS = (
    f"WITH {LISTS}, rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s / den, 9) DESC, id) AS rank FROM f JOIN den USING (qid)), "
    "t AS (SELECT 1 AS run, qid, id FROM rk WHERE rank <= 5 UNION ALL SELECT 0, qid, id FROM l WHERE source = 'cover' AND rank < 5), "
    "h AS (SELECT run, qid, bool_or(contains(d.text, b.text)) AS content, bool_or(d.source = concat('src', b.item_id % 20)) AS own FROM t JOIN benchmark b ON item_id = qid JOIN documents d ON doc_id = id GROUP BY ALL), "
    "r AS (SELECT unnest([0, 1]) AS run), a AS (SELECT run, item_id, CASE item_id % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'extended' ELSE 'holdout' END AS track FROM benchmark, r), "
    "c AS (SELECT a.run, track, count(*) AS total, round(100 * avg(CAST(coalesce(content, false) AS INT)), 4) AS content, round(100 * avg(CAST(coalesce(own, false) AS INT)), 4) AS source FROM a LEFT JOIN h ON h.run = a.run AND qid = item_id GROUP BY ALL) "
    "SELECT x.track, round(x.content - y.content, 4) AS delta_content, round(x.source - y.source, 4) AS delta_source, CASE WHEN x.content - y.content < -5 OR (y.source > 0 AND x.source - y.source < -10) THEN 'failed' ELSE 'aged' END AS verdict FROM c x JOIN c y ON x.track = y.track AND x.run = 1 AND y.run = 0"
)


@query("eval_run_gate", RUNS)
def eval_run_gate(t):
    """The fused recall against a stored run of one list alone, by track. The stored one is a month old, so what passes is
    the next baseline."""
    lists = cut(ranked_lists(t))
    cases = t.benchmark.select(C("item_id").alias("qid"), C("text").alias("expected"), F.concat(F.lit("src"), (C("item_id") % 20).cast("string")).alias("own"))
    track = F.when(C("qid") % 3 == 0, "stable").when(C("qid") % 3 == 1, "extended").otherwise("holdout")

    def report(best):
        found = cases.join(best.select("qid", "id"), "qid", "left").join(t.documents.select(C("doc_id").alias("id"), "text", "source"), "id", "left")
        hit = found.groupBy("qid").agg(F.bool_or(C("text").contains(C("expected"))).alias("content"), F.bool_or(C("source") == C("own")).alias("source"))
        return runs.report(hit.withColumn("track", track))

    folder = f"{shared(t.spark)}/runs-{uuid.uuid4().hex}"
    runs.settle(report(lists.where("source = 'cover' AND rank < 5")), folder, now_() - F.expr("INTERVAL 30 DAY"))
    fused = fusion.rrf(lists, {"jaccard": 0.9, "cover": 1.0})
    return runs.settle(report(joins.top_k(fused, ["qid"], [F.desc(F.round(C("score") / 100, 9)), C("id")], 5)), folder, now_())
