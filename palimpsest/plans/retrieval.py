"""Queries on retrieval as a whole: keyword and hybrid scores, answer confidence, query rules, lifecycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.vector import cosine
from palimpsest.operators import fusion, graph, joins, pairs, retrieval
from palimpsest.plans.bindings import ATOMS, AUDIT, EDGES, NOW, atoms, audit, duck_jaccard, duck_tokens, edges, now_
from palimpsest.plans.joins import COS
from palimpsest.plans.registry import query
from palimpsest.plans.windows import LISTS, ranked_lists

C = F.col
#: Characters of a section that its rank is told by, as the operator defines it.
SECTION = 800
TOKS = "regexp_extract_all(lower(text), '[a-z0-9_\\-]{2,}|[가-힣]{2,}')"


@query("join_bm25", f"WITH d AS (SELECT doc_id AS id, {TOKS} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d), q AS (SELECT DISTINCT item_id AS qid, unnest({TOKS}) AS term FROM benchmark), tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 4) AS score FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL")
def join_bm25(t):
    found = retrieval.bm25(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")
    return found.select("qid", "id", F.round("score", 4).alias("score"))


@query("join_hybrid_blend", f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 1), s AS (SELECT b.vec_id AS id, b.label, {COS} AS v FROM embeddings b, q a), d AS (SELECT doc_id, source, {duck_tokens('text')} AS x FROM documents), k AS (SELECT {duck_tokens('text')} AS k FROM benchmark WHERE item_id = 0) SELECT id, round(least(1.0, greatest(0.0, CASE WHEN (label % 3) * 0.2 <> 0 THEN 0.55 * v + 0.35 * kw + 0.10 * least(1.0, greatest(-0.2, (label % 3) * 0.2 / 0.45)) ELSE 0.61 * v + 0.39 * kw END)), 6) AS score FROM (SELECT s.*, CASE WHEN len(k) = 0 THEN 0.0 ELSE CAST(len(list_intersect(k, x)) AS DOUBLE) / len(k) END AS kw FROM s JOIN d ON id = doc_id, k)")
def join_hybrid_blend(t):
    q = t.embeddings.where("vec_id = 1").select(C("embedding").alias("q"))
    k = t.benchmark.where("item_id = 0").select(text.tokens(C("text")).alias("k"))
    d = t.documents.select(C("doc_id").alias("id"), text.tokens(C("text")).alias("x"))
    s = t.embeddings.join(F.broadcast(q)).select(C("vec_id").alias("id"), "label", cosine(C("q"), C("embedding")).alias("v")).join(d, "id").join(F.broadcast(k))
    return s.select("id", F.round(retrieval.hybrid_blend(C("v"), text.coverage(C("k"), C("x")), (C("label") % 3) * 0.2), 6).alias("score"))


@query("join_hybrid_knn", f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({COS}, 4) AS dense, round(list_dot_product(CAST(a.embedding[1:16] AS DOUBLE[]), CAST(b.embedding[1:16] AS DOUBLE[])), 4) AS short FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, id) - 1 AS rd, row_number() OVER (PARTITION BY qid ORDER BY short DESC, id) - 1 AS rs FROM s), f AS (SELECT qid, id, dense, CASE WHEN rd < 30 THEN 1.0 / (60 + rd) ELSE 0 END + CASE WHEN rs < 20 THEN 1.0 / (60 + rs) ELSE 0 END AS rrf FROM r WHERE rd < 30 OR rs < 20), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, id) <= 30) SELECT qid, id, dense, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, id) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dense DESC, id) <= 10")
def join_hybrid_knn(t):
    """The first by whole vectors and the first by their beginnings, fused; of those the nearest."""
    c = pairs.nearest_and_short(pairs.asked(t.embeddings.where("vec_id % 20 = 0")), pairs.points(t.embeddings), 30, 20, 16)
    place = lambda by: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), "id")) - 1
    part = lambda r, most: F.when(C(r) < most, 1.0 / (60 + C(r))).otherwise(0.0)
    fused = c.withColumn("rd", place("dense")).withColumn("rs", place("short")).where("rd < 30 OR rs < 20").select("qid", "id", "dense", (part("rd", 30) + part("rs", 20)).alias("rrf"))
    first = joins.top_k(fused, ["qid"], [F.desc(F.round("rrf", 9)), C("id")], 30).drop("rank")
    return joins.top_k(first, ["qid"], [F.desc("dense"), C("id")], 10).select("qid", "id", "dense", C("rank").cast("long").alias("rank"))


@query("join_analogs", f"WITH {AUDIT} SELECT route AS repo, event_id FROM audit WHERE outcome IN ('right', 'wrong') AND route <> 'view' QUALIFY row_number() OVER (PARTITION BY route ORDER BY ts DESC, event_id DESC) = 1")
def join_analogs(t):
    a = audit(t).where("outcome IN ('right', 'wrong') AND route <> 'view'")
    return joins.top_k(a.select(C("route").alias("repo"), "event_id", "ts"), ["repo"], [F.desc("ts"), F.desc("event_id")], 1).select("repo", "event_id")


@query("join_episode_peers", f"WITH {AUDIT} SELECT DISTINCT b.atom FROM audit a JOIN audit b ON a.session = b.session WHERE a.atom = 7 AND b.atom IS NOT NULL AND b.atom <> 7")
def join_episode_peers(t):
    a = audit(t).where("atom IS NOT NULL").select("session", "atom")
    return a.join(a.where("atom = 7").select("session"), "session", "left_semi").where("atom <> 7").select("atom").distinct()


@query("join_semantic_supersession", f"WITH {ATOMS}, p AS (SELECT n.id AS new_id, o.id AS old_id, {COS} AS c FROM atoms n JOIN atoms o ON n.topic_key = o.topic_key AND n.id > o.id AND n.created_at >= o.created_at JOIN embeddings a ON a.vec_id = n.id JOIN embeddings b ON b.vec_id = o.id) SELECT new_id, old_id, CASE WHEN c >= 0.85 THEN 'restate' WHEN c < 0.70 THEN 'expire' ELSE 'coexist' END AS verdict FROM p QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY old_id DESC) <= 20")
def join_semantic_supersession(t):
    a = atoms(t).select("id", "topic_key", F.unix_micros(C("created_at").cast("timestamp")).alias("at")).join(t.embeddings.select(C("vec_id").alias("id"), C("embedding").alias("x")), "id")
    c = C("cosine")
    verdict = F.when(c >= 0.85, "restate").when(c < 0.70, "expire").otherwise("coexist")
    return pairs.last_before(a, "topic_key", 20).select("new_id", "old_id", verdict.alias("verdict"))


@query("join_entity_merge", f"WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 4) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, c FROM p WHERE c >= 0.25")
def join_entity_merge(t):
    own = pairs.asked(t.embeddings, "vec_id", "embedding", "label"), pairs.points(t.embeddings, "vec_id", "embedding", "label")
    return pairs.near(*own, 0.25, ("label",)).select(C("id").alias("a"), C("qid").alias("b"), C("cosine").alias("c"))


@query("join_graph_boost", f"WITH {EDGES}, k AS (SELECT src, dst FROM edges WHERE w >= 0.45), n AS (SELECT DISTINCT y.src AS id FROM k x JOIN k y ON x.dst = y.dst WHERE x.src IN (1, 2)), a AS (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS score FROM documents) SELECT a.id, round(CASE WHEN n.id IS NOT NULL THEN score * 1.15 ELSE score END, 4) AS score FROM a LEFT JOIN n ON a.id = n.id")
def join_graph_boost(t):
    """A memory is the document of a customer's number; strong edges lead from the questions' entities to it in two steps."""
    k = edges(t).where("w >= 0.45").select("src", "dst")
    n = k.join(k.where("src IN (1, 2)").select("dst"), "dst", "left_semi").select(C("src").alias("id")).distinct().withColumn("near", F.lit(True))
    a = t.documents.select(C("doc_id").alias("id"), C("n_chars").cast("double").alias("score")).join(n, "id", "left")
    return a.select("id", F.round(F.when(C("near"), C("score") * 1.15).otherwise(C("score")), 4).alias("score"))


@query("rank_crag", f"WITH {LISTS}, r AS (SELECT qid, 100 * s / den AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s / den, 9) DESC, id) AS k FROM f JOIN den USING (qid)), g AS (SELECT qid, max(score) AS top, max(score) - min(score) AS spread, var_pop(score / 100) AS v, count(*) AS n FROM r WHERE k <= 5 GROUP BY qid) SELECT qid, round((least(1.0, greatest(0.0, (top - 60) / 20)) + least(1.0, greatest(0.0, (spread - 8) / 17)) + 0 + least(1.0, 50 * v) + least(1.0, n / 3.0)) / 5 * 0.7, 6) AS confidence FROM g")
def rank_crag(t):
    fused = fusion.rrf(ranked_lists(t), {"jaccard": 0.9, "cover": 1.0})
    top = joins.top_k(fused, ["qid"], [F.desc(F.round(C("score") / 100, 9)), C("id")], 5)
    g = top.groupBy("qid").agg(F.max("score").alias("top"), (F.max("score") - F.min("score")).alias("spread"), F.var_pop(C("score") / 100).alias("v"), F.count("*").alias("n"))
    return g.select("qid", F.round(retrieval.crag_confidence(C("top"), C("spread"), F.lit(False), C("v"), C("n"), F.lit(0.6)), 6).alias("confidence"))


@query("rank_maxsim", f"WITH s AS (SELECT a.label AS query, a.vec_id AS phrase, b.vec_id % 40 AS doc, max({COS}) AS m FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL) SELECT query, doc, round(least(1.0, avg(m)), 4) AS score FROM s GROUP BY ALL")
def rank_maxsim(t):
    """A phrase is a vector, and its query its label."""
    asked, docs = t.embeddings.where("vec_id % 20 = 0"), pairs.points(t.embeddings, "vec_id", "embedding", (C("vec_id") % 40).alias("doc"))
    s = pairs.best_of_groups(pairs.asked(asked, "vec_id", "embedding", C("label").alias("query")), docs, "doc", keep=("query",))
    return s.groupBy("query", "doc").agg(F.round(F.least(F.lit(1.0), F.avg("m")), 4).alias("score"))


@query("rank_triple_bonus", "SELECT doc_id, CAST(least(15, 5 * len(list_filter(['tion', 'ment', 'ering', 'nder'], lambda w: regexp_matches(lower(text), '(^|[^a-z0-9_])' || w || '($|[^a-z0-9_])')))) AS INT) AS bonus FROM documents")
def rank_triple_bonus(t):
    words = F.array(*map(F.lit, ("tion", "ment", "ering", "nder")))
    hits = F.size(F.filter(words, lambda w: F.regexp_like(F.lower("text"), F.concat(F.lit("(^|[^a-z0-9_])"), w, F.lit("($|[^a-z0-9_])")))))
    return t.documents.select("doc_id", F.least(F.lit(15), 5 * hits).alias("bonus"))


@query("rank_activation_gate", f"WITH {ATOMS}, r AS (SELECT id, topic_key, confidence, row_number() OVER (PARTITION BY topic_key ORDER BY confidence DESC, id) AS k FROM atoms), g AS (SELECT topic_key, max(confidence) FILTER (k = 3) / nullif(max(confidence) FILTER (k = 1), 0) >= 0.9 AS go FROM r GROUP BY topic_key) SELECT id, round(confidence * 100 + CASE WHEN go THEN 5 * coalesce(trust, 0) ELSE 0 END, 6) AS score FROM atoms JOIN g USING (topic_key)")
def rank_activation_gate(t):
    a = atoms(t)
    r = a.select("id", "topic_key", "confidence").withColumn("k", F.row_number().over(Window.partitionBy("topic_key").orderBy(F.desc("confidence"), "id")))
    at = lambda k: F.max(F.when(C("k") == k, C("confidence")))
    g = r.groupBy("topic_key").agg((at(3) / F.nullif(at(1), F.lit(0.0)) >= 0.9).alias("go"))
    return a.join(g, "topic_key").select("id", F.round(C("confidence") * 100 + F.when(C("go"), 5 * F.coalesce("trust", F.lit(0.0))).otherwise(0), 6).alias("score"))


@query("rank_peer_bonus", f"WITH {ATOMS}, r AS (SELECT id, topic_key, confidence * 100 AS s, row_number() OVER (PARTITION BY topic_key ORDER BY confidence DESC, id) AS k FROM atoms), f AS (SELECT topic_key, min(s) AS low FROM r WHERE k <= 3 GROUP BY topic_key) SELECT id, round(CASE WHEN k > 3 THEN s + least(2, greatest(0, low - 0.1 - s)) ELSE s END, 6) AS score FROM r JOIN f USING (topic_key)")
def rank_peer_bonus(t):
    w = Window.partitionBy("topic_key")
    r = atoms(t).select("id", "topic_key", (C("confidence") * 100).alias("s"), F.row_number().over(w.orderBy(F.desc("confidence"), "id")).alias("k"))
    f = r.where("k <= 3").groupBy("topic_key").agg(F.min("s").alias("low"))
    lifted = C("s") + F.least(F.lit(2.0), F.greatest(F.lit(0.0), C("low") - 0.1 - C("s")))
    return r.join(f, "topic_key").select("id", F.round(F.when(C("k") > 3, lifted).otherwise(C("s")), 6).alias("score"))


@query("rank_prompt_sections", f"WITH p AS (SELECT {duck_tokens('text')} AS p FROM benchmark WHERE item_id = 2), d AS (SELECT doc_id, {duck_tokens(f'substr(text, 1, {SECTION})')} AS x FROM documents) SELECT doc_id, row_number() OVER (ORDER BY round({duck_jaccard('p', 'x')}, 9) DESC, doc_id) AS place FROM d, p ORDER BY place LIMIT 15")
def rank_prompt_sections(t):
    p = t.benchmark.where("item_id = 2").select(text.tokens(C("text")).alias("p"))
    d = t.documents.select("doc_id", text.tokens(F.substring("text", 1, SECTION)).alias("x")).join(F.broadcast(p))
    top = d.select("doc_id", F.round(text.jaccard(C("p"), C("x")), 9).alias("j")).orderBy(F.desc("j"), "doc_id").limit(15)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("j"), "doc_id")).cast("long").alias("place"))


@query("rank_structural", f"WITH {ATOMS}, q AS (SELECT {duck_tokens('text')} AS q FROM benchmark WHERE item_id = 1), s AS (SELECT topic_key, {duck_jaccard('q', 'x')} AS j, confidence, greatest(0, 1 - (epoch({NOW}) - epoch(created_at)) / 86400 / 180) AS fresh FROM (SELECT *, {duck_tokens('text')} AS x FROM atoms QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY confidence DESC, id) <= 3), q) SELECT topic_key, round(0.60 * max(j) + 0.25 * avg(confidence) + 0.15 * avg(fresh), 6) AS score FROM s GROUP BY topic_key")
def rank_structural(t):
    from palimpsest.functions.temporal import age_days

    q = t.benchmark.where("item_id = 1").select(text.tokens(C("text")).alias("q"))
    top = joins.top_k(atoms(t), ["topic_key"], [F.desc("confidence"), C("id")], 3).join(F.broadcast(q))
    fresh = F.greatest(F.lit(0.0), 1 - age_days(C("created_at"), now_()) / 180)
    return top.groupBy("topic_key").agg(F.round(0.60 * F.max(text.jaccard(C("q"), text.tokens(C("text")))) + 0.25 * F.avg("confidence") + 0.15 * F.avg(fresh), 6).alias("score"))


# -- questions

INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p, _ in retrieval.INTENTS) + " ELSE 'general' END"


@query("qry_intent", f"SELECT conv_id, turn, {INTENT_SQL} AS intent FROM conversations")
def qry_intent(t):
    return t.conversations.select("conv_id", "turn", retrieval.intent(C("text")).alias("intent"))


@query("qry_intent_weights", f"WITH i AS (SELECT {INTENT_SQL} AS intent FROM conversations) SELECT intent, count(*) AS n, CAST(max(CASE intent " + " ".join(f"WHEN '{n}' THEN {w[0]}" for n, _, w in retrieval.INTENTS) + " ELSE 1.0 END) AS DOUBLE) AS graph FROM i GROUP BY intent")
def qry_intent_weights(t):
    i = t.conversations.select(retrieval.intent(C("text")).alias("intent"))
    return i.groupBy("intent").agg(F.count("*").alias("n"), F.max(retrieval.intent_weight(C("intent"), 0)).alias("graph"))


@query("qry_complexity", f"WITH q AS (SELECT conv_id, turn, len({duck_tokens('text')}) AS n, regexp_matches(lower(text), '\\b(and|or|versus|vs|compare|both)\\b') AS several FROM conversations) SELECT conv_id, turn, CASE WHEN several AND n > 6 THEN 'multi' WHEN n > 4 OR several THEN 'single' ELSE 'simple' END AS kind FROM q")
def qry_complexity(t):
    return t.conversations.select("conv_id", "turn", retrieval.complexity(C("text")).alias("kind"))


@query("qry_latin_variants", "SELECT item_id, array_to_string(regexp_extract_all(text, '[A-Za-z]{4,}')[1:6], ' ') AS variant FROM benchmark")
def qry_latin_variants(t):
    return t.benchmark.select("item_id", F.array_join(F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1)), 1, 6), " ").alias("variant"))


@query("qry_phrases", "SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,.;:!?\\n]+'), lambda p: trim(p)), lambda p: length(p) >= 10)[1:5], '|') AS phrases FROM benchmark")
def qry_phrases(t):
    return t.benchmark.select("item_id", F.array_join(retrieval.phrases(C("text")), "|").alias("phrases"))


@query("qry_ontology_terms", f"WITH {EDGES} SELECT src AS name, dst AS term FROM edges WHERE src IN (5, 6, 7) QUALIFY row_number() OVER (PARTITION BY src ORDER BY edges.w DESC, n DESC, dst) <= 3")
def qry_ontology_terms(t):
    e = edges(t).where("src IN (5, 6, 7)")
    return joins.top_k(e, ["src"], [F.desc("w"), F.desc("n"), C("dst")], 3).select(C("src").alias("name"), C("dst").alias("term"))


# -- graph and lifecycles


@query("graph_alias_join", "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON list_contains([n_name, lower(n_name)], CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE lower(n_name) END) AND c_nationkey = n_nationkey")
def graph_alias_join(t):
    aliases = t.nation.select("n_nationkey", F.explode(F.array("n_name", F.lower("n_name"))).alias("alias"), "n_name").distinct()
    said = t.customer.join(t.nation.select(C("n_nationkey").alias("own"), C("n_name").alias("own_name")), C("c_nationkey") == C("own")).select("c_custkey", "own", F.when(C("c_custkey") % 2 == 0, C("own_name")).otherwise(F.lower("own_name")).alias("said"))
    return said.join(aliases, C("said") == C("alias")).where("own = n_nationkey").select("c_custkey", "n_nationkey").distinct()


@query("graph_hebbian", f"WITH {EDGES} SELECT src, dst, round(least(1.0, w + 0.05 * (n % 4)), 6) AS w FROM edges")
def graph_hebbian(t):
    return edges(t).select("src", "dst", F.round(F.least(F.lit(1.0), C("w") + 0.05 * (C("n") % 4)), 6).alias("w"))


@query("graph_summaries", f"WITH s AS (SELECT source, list_distinct(flatten(list({duck_tokens('text')}))) AS x FROM documents GROUP BY source), q AS (SELECT list_filter({duck_tokens('text')}, lambda w: length(w) >= 4) AS q FROM benchmark WHERE item_id = 3) SELECT source FROM s, q WHERE list_has_any(x, q)")
def graph_summaries(t):
    s = t.documents.select("source", F.explode(text.tokens(C("text"))).alias("w"))
    q = t.benchmark.where("item_id = 3").select(F.explode(text.tokens(C("text"))).alias("w")).where("length(w) >= 4")
    return s.join(q, "w", "left_semi").select("source").distinct()


@query("state_write_class", f"WITH s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(1 - {COS}, 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE a.vec_id % 20 = 0), m AS (SELECT id, other, d FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) = 1) SELECT id, other, CASE WHEN d < 0.4 THEN 'NOOP' WHEN d < 0.65 THEN 'UPDATE' ELSE 'ADD' END AS operation FROM m")
def state_write_class(t):
    s = pairs.nearest(pairs.asked(t.embeddings.where("vec_id % 20 = 0")), pairs.points(t.embeddings), 1, pairs.OLDER, apart=True)
    d = C("cosine")
    return s.select(C("qid").alias("id"), C("id").alias("other"), F.when(d < 0.4, "NOOP").when(d < 0.65, "UPDATE").otherwise("ADD").alias("operation"))


@query("state_novelty", f"SELECT a.vec_id AS id, round(1 - max({COS}), 4) AS novelty FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id")
def state_novelty(t):
    asked, of = pairs.asked(t.embeddings.where("vec_id % 20 = 0")), pairs.points(t.embeddings, "vec_id", "embedding", F.lit(0).alias("all"))
    return pairs.best_of_groups(asked, of, "all", pairs.OLDER).select(C("qid").alias("id"), F.round(1 - C("m"), 4).alias("novelty"))


@query("state_working_memory", f"WITH {AUDIT} SELECT session, route, arg_max(event_id, CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id % 100000) AS newest, count(*) AS n FROM audit GROUP BY session, route HAVING count(*) >= 2")
def state_working_memory(t):
    order = F.struct("ts", (C("event_id") % 100000).alias("e"))
    return audit(t).groupBy("session", "route").agg(F.max_by("event_id", order).alias("newest"), F.count("*").alias("n")).where("n >= 2")


@query("state_superseded_unused", f"WITH {ATOMS}, {AUDIT} SELECT id FROM atoms WHERE superseded_by IS NOT NULL AND id NOT IN (SELECT atom FROM audit WHERE atom IS NOT NULL) AND created_at < {NOW} - INTERVAL 30 DAY")
def state_superseded_unused(t):
    old = atoms(t).where("superseded_by IS NOT NULL").where(C("created_at") < now_() - F.expr("INTERVAL 30 DAY")).select("id")
    return old.join(audit(t).where("atom IS NOT NULL").select(C("atom").alias("id")), "id", "left_anti")


@query("state_trust_recompute", f"WITH {ATOMS}, {AUDIT}, u AS (SELECT atom, count(*) AS n FROM audit GROUP BY atom), r AS (SELECT id, trust, round(least(1.0, 0.4 + 0.1 * coalesce(n, 0)), 6) AS fresh FROM atoms LEFT JOIN u ON id = atom) SELECT id, CAST(fresh AS DOUBLE) AS trust FROM r WHERE trust IS NULL OR abs(fresh - trust) >= 0.05")
def state_trust_recompute(t):
    u = audit(t).groupBy(C("atom").alias("id")).agg(F.count("*").alias("n"))
    r = atoms(t).select("id", "trust").join(u, "id", "left").withColumn("fresh", F.round(F.least(F.lit(1.0), 0.4 + 0.1 * F.coalesce("n", F.lit(0))), 6))
    return r.where("trust IS NULL OR abs(fresh - trust) >= 0.05").select("id", C("fresh").alias("trust"))


@query("eval_diversity", f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) SELECT a.label, round(1 - avg({COS}), 4) AS diversity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.k <= 5 AND b.k <= 5 GROUP BY a.label")
def eval_diversity(t):
    e = joins.top_k(t.embeddings, ["label"], [C("vec_id")], 5).select("label", "vec_id", "embedding")
    b = e.toDF("label", "other", "y")
    return e.join(b, "label").where("vec_id < other").groupBy("label").agg(F.round(1 - F.avg(cosine(C("embedding"), C("y"))), 4).alias("diversity"))


@query("eval_gate", "WITH m AS (SELECT source, avg(quality) AS base, avg(quality) FILTER (doc_id % 2 = 0) AS now FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, round(now - base, 6) AS delta, coalesce(now < base - 0.05, FALSE) AS failed FROM m")
def eval_gate(t):
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.avg("quality").alias("base"), F.avg(F.when(C("doc_id") % 2 == 0, C("quality"))).alias("now"))
    return j.select("source", F.round(C("now") - C("base"), 6).alias("delta"), F.coalesce(C("now") < C("base") - 0.05, F.lit(False)).alias("failed"))


@query("eval_visibility_gaps", f"WITH {AUDIT} SELECT count(*) AS gaps FROM audit WHERE outcome IS NOT NULL AND (atom IS NULL OR atom NOT IN (SELECT doc_id FROM labels))")
def eval_visibility_gaps(t):
    a = audit(t).where("outcome IS NOT NULL").select("event_id", "atom")
    return a.join(t.labels.select(C("doc_id").alias("atom")), "atom", "left_anti").agg(F.count("*").alias("gaps"))


@query("eval_open_loops", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_matches(lower(text), '\\b(will|todo|later|for|need)\\b')")
def eval_open_loops(t):
    return t.conversations.where("role = 'user'").where(F.lower("text").rlike(r"\b(will|todo|later|for|need)\b")).select("conv_id", "turn")
