"""Queries on ranking stages, state transitions and the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import temporal, text
from palimpsest.operators import graph, joins, rank, state
from palimpsest.plans.bindings import ATOMS, AUDIT, EDGES, NOW, atoms, audit, duck_decay, duck_jaccard, duck_tokens, edges, now_
from palimpsest.plans.joins import PART_EDGES, part_edges
from palimpsest.plans.registry import query
from palimpsest.plans.windows import LISTS, ranked_lists

C = F.col
#: Characters that stand for a title, and those of a body that the rerank reads, as the operator defines it.
TITLE, BODY = 40, 1500
AGE = f"greatest(0.0, (epoch({NOW}) - epoch(created_at)) / 86400)"


@query("rank_decay", f"WITH {ATOMS} SELECT id, round({duck_decay('created_at', 'collection', 'valid_until')}, 6) AS weight FROM atoms".replace("created_at < NULL", "FALSE"))
def rank_decay(t):
    return atoms(t).select("id", F.round(temporal.decay(C("created_at"), C("collection"), C("valid_until"), now_()), 6).alias("weight"))


@query("rank_effective_trust", f"WITH {ATOMS} SELECT id, CAST(round(CASE collection WHEN 'canonical' THEN greatest(0.8, 1.0 - 0.02 * {AGE}) WHEN 'knowledge' THEN greatest(0.8, 0.9 - 0.005 * {AGE}) WHEN 'personal' THEN 0.85 WHEN 'experience' THEN 0.85 WHEN 'semantic' THEN 0.8 WHEN 'context' THEN 0.75 WHEN 'obsidian' THEN 0.6 ELSE 0.7 END, 6) AS DOUBLE) AS trust FROM atoms")
def rank_effective_trust(t):
    return atoms(t).select("id", F.round(temporal.effective_trust(C("collection"), C("created_at"), now_()), 6).alias("trust"))


@query("rank_overlap", f"WITH {LISTS}, h AS (SELECT doc_id, {duck_tokens(f'substr(text, 1, {TITLE})')} AS h, {duck_tokens(f'substr(text, 1, {BODY})')} AS b FROM documents), o AS (SELECT q.item_id, h.doc_id, {duck_jaccard('q', 'h')} AS jt, {duck_jaccard('q', 'b')} AS jb FROM (SELECT DISTINCT qid, id FROM k) c JOIN q ON q.item_id = c.qid JOIN h ON h.doc_id = c.id) SELECT item_id, doc_id, round((1 + 2 * jt + jb) * CASE WHEN jt = 0 AND jb < 0.05 THEN 0.6 ELSE 1.0 END, 6) AS factor FROM o")
def rank_overlap(t):
    """All candidates of all questions: what their ranked lists hold."""
    q = t.benchmark.select("item_id", text.tokens(C("text")).alias("q"))
    d = t.documents.select("doc_id", text.tokens(F.substring("text", 1, TITLE)).alias("h"), text.tokens(F.substring("text", 1, BODY)).alias("b"))
    candidates = ranked_lists(t).select(C("qid").alias("item_id"), C("id").alias("doc_id")).distinct()
    return candidates.join(q, "item_id").join(d, "doc_id").select("item_id", "doc_id", F.round(rank.overlap_rerank(C("q"), C("h"), C("b")), 6).alias("factor"))


@query("rank_position", "SELECT doc_id, round(CASE WHEN strpos(lower(text), 'tion') = 0 THEN 1.0 ELSE 1 + 0.5 * greatest(0.0, 1 - (strpos(lower(text), 'tion') - 1) / 500) END, 6) AS bonus FROM documents")
def rank_position(t):
    return t.documents.select("doc_id", F.round(rank.position_bonus(F.instr(F.lower("text"), "tion") - 1), 6).alias("bonus"))


@query("rank_source_quality", f"WITH {ATOMS} SELECT id, CASE kind WHEN 'raw_dump' THEN 0.4::DOUBLE WHEN 'event' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM atoms")
def rank_source_quality(t):
    kind = F.when(C("kind") == "raw_dump", "session_dump").when(C("kind") == "event", "log").otherwise("other")
    return atoms(t).select("id", rank.source_quality(kind).alias("factor"))


@query("rank_deboost", f"WITH {ATOMS} SELECT id, round(CASE WHEN quality < 0.5 THEN 0.7 + 0.5 * quality ELSE 1.0 END, 6) AS factor, round(CASE WHEN 2 * confidence - 1 > 0 THEN 1 + 0.15 * (2 * confidence - 1) WHEN 2 * confidence - 1 < 0 THEN 1 + 0.10 * (2 * confidence - 1) ELSE 1.0 END, 6) AS valence, round(0.4 + 0.6 * coalesce(trust, 0.7), 6) AS trusted FROM atoms")
def rank_deboost(t):
    v = 2 * C("confidence") - 1
    return atoms(t).select("id", F.round(rank.deboost(C("quality")), 6).alias("factor"), F.round(rank.valence_boost(v), 6).alias("valence"), F.round(rank.trust_multiplier(C("trust")), 6).alias("trusted"))


@query("rank_salience", f"WITH {ATOMS} SELECT id, round(10 * (pow(0.5, {AGE} / 90) + (least(coalesce(trust, 0.7), 1.0) + least(ln(1 + accesses) / ln(50.0), 1.0)) / 2) / 2, 6) AS bonus FROM atoms")
def rank_salience(t):
    return atoms(t).select("id", F.round(rank.salience(temporal.age_days(C("created_at"), now_()), C("trust"), C("accesses")), 6).alias("bonus"))


LTR = [0.8, 0.5, 0.3, -0.2]


@query("rank_ltr", f"WITH {ATOMS} SELECT id, round(0.75 * (confidence * 100) + 0.25 * 100 / (1 + exp(-(-0.4 + confidence * 0.8 + coalesce(trust, 0.7) * 0.5 + quality * 0.3 + (accesses / 60) * -0.2))), 6) AS score FROM atoms")
def rank_ltr(t):
    c = atoms(t).withColumn("score", C("confidence") * 100)
    features = [C("confidence"), F.coalesce("trust", F.lit(0.7)), C("quality"), C("accesses") / 60]
    return rank.ltr(features, LTR, -0.4)(c).select("id", F.round("score", 6).alias("score"))


@query("rank_ce_blend", f"WITH {ATOMS}, s AS (SELECT id, topic_key, confidence * 100 AS score, quality * 4 - 1 AS ce FROM atoms), n AS (SELECT *, CASE WHEN min(ce) OVER w >= 0 AND max(ce) OVER w <= 1 THEN sqrt(greatest(ce, 0)) ELSE 1 / (1 + exp(-ce)) END AS norm FROM s WINDOW w AS (PARTITION BY topic_key)) SELECT id, round(0.2 * score + 80 * norm, 6) AS score FROM n")
def rank_ce_blend(t):
    w = Window.partitionBy("topic_key")
    s = atoms(t).select("id", "topic_key", (C("confidence") * 100).alias("score"), (C("quality") * 4 - 1).alias("ce"))
    inside = (F.min("ce").over(w) >= 0) & (F.max("ce").over(w) <= 1)
    n = s.withColumn("norm", F.when(inside, F.sqrt(F.greatest(C("ce"), F.lit(0.0)))).otherwise(1 / (1 + F.exp(-C("ce")))))
    return n.select("id", F.round(0.2 * C("score") + 80 * C("norm"), 6).alias("score"))


@query("rank_support", f"WITH {ATOMS} SELECT id, round((0.5 * confidence + 0.35 * coalesce(trust, 0.5) + 0.15 * quality) * CASE WHEN valid_until < {NOW} THEN 0.4 WHEN created_at < {NOW} - INTERVAL 180 DAY THEN 0.7 ELSE 1.0 END, 9) AS support FROM atoms")
def rank_support(t):
    expired, stale = C("valid_until") < now_(), C("created_at") < now_() - F.expr("INTERVAL 180 DAY")
    return atoms(t).select("id", F.round(rank.support(C("confidence"), C("trust"), C("quality"), expired, stale), 9).alias("support"))


@query("rank_authority", f"WITH {ATOMS} SELECT id, round(CASE tier WHEN 'core' THEN 0.45 WHEN 'semantic' THEN 0.30 WHEN 'episodic' THEN 0.10 WHEN 'obsolete' THEN -0.60 ELSE 0 END + 0.35 * confidence + 0.20 * coalesce(trust, 0) + CASE WHEN collection = 'canonical' THEN 0.15 ELSE 0 END - CASE WHEN superseded_by IS NOT NULL THEN 0.85 ELSE 0 END, 9) AS authority FROM atoms")
def rank_authority(t):
    return atoms(t).select("id", F.round(rank.authority(C("tier"), C("confidence"), C("trust"), C("collection") == "canonical", C("superseded_by").isNotNull()), 9).alias("authority"))


@query("rank_conflict_flags", f"WITH {ATOMS}, r AS (SELECT id, topic_key, collection, {duck_tokens('text')} AS x FROM atoms QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY confidence DESC, id) <= 10) SELECT DISTINCT a.id FROM r a JOIN r b ON a.topic_key = b.topic_key AND a.id <> b.id AND a.collection <> b.collection WHERE {duck_jaccard('a.x', 'b.x')} > 0.3 AND {duck_jaccard('a.x', 'b.x')} < 0.7")
def rank_conflict_flags(t):
    r = joins.top_k(atoms(t).select("id", "topic_key", "collection", "confidence", "text"), ["topic_key"], [F.desc("confidence"), C("id")], 10).select("id", "topic_key", "collection", text.tokens(C("text")).alias("x"))
    b = r.toDF("b_id", "topic_key", "b_collection", "y")
    j = text.jaccard(C("x"), C("y"))
    return r.join(b, "topic_key").where("id <> b_id AND collection <> b_collection").where((j > 0.3) & (j < 0.7)).select("id").distinct()


@query("rank_cascade", f"WITH {ATOMS}, s AS (SELECT id, topic_key, confidence * 100 * (0.4 + 0.6 * coalesce(trust, 0.7)) * {duck_decay('created_at', 'collection', 'valid_until')} + CASE WHEN collection = 'canonical' THEN 8 ELSE 0 END AS score FROM atoms) SELECT topic_key, id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY round(score, 8) DESC, id) <= 5")
def rank_cascade(t):
    stages = [
        rank.Stage("trust", rank.scaled(rank.trust_multiplier(C("trust")))),
        rank.Stage("decay", rank.decayed(now_())),
        rank.Stage("canonical", rank.added(F.when(C("collection") == "canonical", 8).otherwise(0))),
        rank.Stage("salience", rank.added(rank.salience(temporal.age_days(C("created_at"), now_()), C("trust"), C("accesses"))), enabled=False),
    ]
    s = rank.run(atoms(t).withColumn("score", C("confidence") * 100), stages)
    return joins.top_k(s, ["topic_key"], [F.desc(F.round("score", 8)), C("id")], 5).select("topic_key", "id", F.round("score", 4).alias("score"))


# -- state


@query("state_sm2", f"WITH {ATOMS}, s AS (SELECT id, reinforced AS n, interval_days AS i, least(5, CAST(floor(quality * 6) AS INT)) AS q, greatest(1.3, easiness + 0.1 - (5 - least(5, CAST(floor(quality * 6) AS INT))) * (0.08 + (5 - least(5, CAST(floor(quality * 6) AS INT))) * 0.02)) AS ef FROM atoms) SELECT id, round(ef, 4) AS easiness, CAST(CASE WHEN q < 3 THEN 0 ELSE n + 1 END AS INT) AS reinforced, round(CASE WHEN q < 3 OR n = 0 THEN 1.0 WHEN n = 1 THEN 6.0 ELSE i * ef END, 4) AS interval_days FROM s")
def state_sm2(t):
    q = F.least(F.lit(5), F.floor(C("quality") * 6).cast("int"))
    ef, n, i = state.sm2(C("easiness"), C("reinforced"), C("interval_days"), q)
    return atoms(t).select("id", F.round(ef, 4).alias("easiness"), n.cast("int").alias("reinforced"), F.round(i, 4).alias("interval_days"))


@query("state_tier_promotion", f"WITH {ATOMS} SELECT id, CASE WHEN tier = 'episodic' AND reinforced >= 2 AND interval_days >= 6 THEN 'semantic' WHEN tier = 'semantic' AND reinforced >= 5 AND interval_days >= 30 AND collection <> 'canonical' THEN 'core' ELSE tier END AS tier, tier <> 'core' AND reinforced = 0 AND (next_review IS NULL OR next_review < {NOW} - INTERVAL 180 DAY) AS obsolete FROM atoms")
def state_tier_promotion(t):
    obsolete = (C("tier") != "core") & (C("reinforced") == 0) & (C("next_review").isNull() | (C("next_review") < now_() - F.expr("INTERVAL 180 DAY")))
    return atoms(t).select("id", state.promoted(C("tier"), C("reinforced"), C("interval_days"), C("collection") == "canonical").alias("tier"), obsolete.alias("obsolete"))


@query("state_ratchet", f"WITH {ATOMS} SELECT topic_key, max(CASE tier WHEN 'core' THEN 3 WHEN 'semantic' THEN 2 WHEN 'episodic' THEN 1 ELSE 0 END) AS tier_rank, max(CASE WHEN collection = 'canonical' THEN 1 ELSE 0 END) AS canonical, CAST(epoch(min(created_at)) AS BIGINT) AS valid_from, arg_max(id, id) AS newest FROM atoms GROUP BY topic_key")
def state_ratchet(t):
    return atoms(t).groupBy("topic_key").agg(F.max(state.tier_rank(C("tier"))).alias("tier_rank"), F.max(F.when(C("collection") == "canonical", 1).otherwise(0)).alias("canonical"), F.min("created_at").cast("timestamp").cast("long").alias("valid_from"), F.max_by("id", "id").alias("newest"))


@query("state_rollback", f"WITH {AUDIT}, e AS (SELECT atom, sum(CASE outcome WHEN 'right' THEN 0.4 WHEN 'wrong' THEN -0.6 ELSE 0.0 END / greatest(1, actor)) AS s FROM audit WHERE atom IS NOT NULL GROUP BY atom) SELECT atom, round(least(0.98, greatest(0.02, 1 / (1 + exp(-s)))), 6) AS confidence FROM e")
def state_rollback(t):
    weight = F.when(C("outcome") == "right", 0.4).when(C("outcome") == "wrong", -0.6).otherwise(0.0)
    e = audit(t).where("atom IS NOT NULL").groupBy("atom").agg(F.sum(weight / F.greatest(F.lit(1), C("actor"))).alias("s"))
    return e.select("atom", F.round(state.rolled_back(C("s")), 6).alias("confidence"))


@query("state_ledger")
def state_ledger(t):
    """The clamped fold; state_rollback is its closed form."""
    weight = F.when(C("outcome") == "right", 0.4).when(C("outcome") == "wrong", -0.6).otherwise(0.0)
    e = audit(t).where("atom IS NOT NULL").select("atom", "event_id", weight.alias("weight"), F.greatest(F.lit(1), C("actor")).cast("int").alias("cluster"))
    return state.ledger(e).select("atom", F.round("confidence", 6).alias("confidence"))


@query("state_facts")
def state_facts(t):
    f = t.orders.select(C("o_custkey").cast("string").alias("entity"), C("o_orderpriority").alias("attribute"), C("o_orderstatus").alias("value"), C("o_orderkey").alias("seq"), (C("o_totalprice") % 100 / 100).alias("confidence"))
    return state.fact_versions(f)


@query("state_supersession", f"WITH {ATOMS}, e AS (SELECT id AS child, supersedes AS parent FROM atoms WHERE supersedes IS NOT NULL UNION SELECT superseded_by, id FROM atoms WHERE superseded_by IS NOT NULL) SELECT parent, max(child) AS child FROM e GROUP BY parent")
def state_supersession(t):
    a = atoms(t)
    e = a.where("supersedes IS NOT NULL").select(C("id").alias("child"), C("supersedes").alias("parent")).union(a.where("superseded_by IS NOT NULL").select("superseded_by", "id"))
    return e.groupBy("parent").agg(F.max("child").alias("child"))


@query("state_orphans", f"WITH {ATOMS} SELECT id FROM atoms a WHERE superseded_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM atoms b WHERE b.id = a.superseded_by)")
def state_orphans(t):
    a = atoms(t)
    return a.where("superseded_by IS NOT NULL").select("id", "superseded_by").join(a.select(C("id").alias("superseded_by")), "superseded_by", "left_anti").select("id")


@query("state_consolidation", f"WITH {ATOMS} SELECT id, CASE WHEN created_at < {NOW} - INTERVAL 180 DAY AND confidence < 0.1 THEN 'drop' WHEN created_at < {NOW} - INTERVAL 7 DAY AND confidence < 0.2 THEN 'compress' WHEN created_at < {NOW} - INTERVAL 3 DAY AND confidence < 0.3 THEN 'fade' ELSE 'keep' END AS action FROM atoms")
def state_consolidation(t):
    old = lambda d: C("created_at") < now_() - F.expr(f"INTERVAL {d} DAY")
    return atoms(t).select("id", F.when(old(180) & (C("confidence") < 0.1), "drop").when(old(7) & (C("confidence") < 0.2), "compress").when(old(3) & (C("confidence") < 0.3), "fade").otherwise("keep").alias("action"))


@query("state_deboost_weights", f"WITH {AUDIT}, c AS (SELECT atom, count(*) FILTER (outcome = 'wrong') AS w, count(*) FILTER (outcome = 'right') AS r FROM audit WHERE atom IS NOT NULL GROUP BY atom) SELECT atom, CAST(round(least(1.0, greatest(0.05, 1 - 0.15 * w + 0.10 * r)), 6) AS DOUBLE) AS weight FROM c WHERE abs(least(1.0, greatest(0.05, 1 - 0.15 * w + 0.10 * r)) - 1) >= 0.001 ORDER BY atom LIMIT 200")
def state_deboost_weights(t):
    c = audit(t).where("atom IS NOT NULL").groupBy("atom").agg(F.count(F.when(C("outcome") == "wrong", 1)).alias("w"), F.count(F.when(C("outcome") == "right", 1)).alias("r"))
    new = F.least(F.lit(1.0), F.greatest(F.lit(0.05), 1 - 0.15 * C("w") + 0.10 * C("r")))
    return c.withColumn("weight", new).where(F.abs(C("weight") - 1) >= 0.001).orderBy("atom").limit(200).select("atom", F.round("weight", 6).alias("weight"))


@query("state_graduation", f"WITH {AUDIT}, c AS (SELECT session, count(*) AS runs, count(*) FILTER (outcome = 'right') AS passes FROM audit WHERE outcome IS NOT NULL GROUP BY session) SELECT session, CASE WHEN runs >= 4 AND passes / runs >= 0.5 THEN 'graduate' WHEN runs >= 5 AND passes <= 1 THEN 'reject' ELSE 'hold' END AS verdict FROM c")
def state_graduation(t):
    c = audit(t).where("outcome IS NOT NULL").groupBy("session").agg(F.count("*").alias("runs"), F.count(F.when(C("outcome") == "right", 1)).alias("passes"))
    return c.select("session", F.when((C("runs") >= 4) & (C("passes") / C("runs") >= 0.5), "graduate").when((C("runs") >= 5) & (C("passes") <= 1), "reject").otherwise("hold").alias("verdict"))


@query("state_transitions", "WITH n AS (SELECT event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, after, count(*) AS n, (before = 'signup' AND after IN ('view', 'click')) OR (before IN ('view', 'click') AND after <> 'signup') AS allowed FROM n WHERE before IS NOT NULL GROUP BY ALL")
def state_transitions(t):
    n = t.events.select(C("event_type").alias("after"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before")).where("before IS NOT NULL")
    allowed = ((C("before") == "signup") & C("after").isin("view", "click")) | (C("before").isin("view", "click") & (C("after") != "signup"))
    return n.groupBy("before", "after").agg(F.count("*").alias("n")).withColumn("allowed", allowed)


@query("state_breaker")
def state_breaker(t):
    e = t.events.select(C("user_id").alias("kind"), C("event_id").alias("seq"), (C("event_type") != "error").alias("ok"))
    return state.breaker(e, 2, 3)


@query("state_utility")
def state_utility(t):
    e = audit(t).where("atom IS NOT NULL AND outcome IN ('right', 'wrong')").select("atom", "event_id", (C("outcome") == "right").alias("success"))
    return state.utility(e).select("atom", F.round("utility", 6).alias("utility"))


# -- graph


@query("graph_projection", f"WITH {EDGES} SELECT a, b, round(max(w), 6) AS w FROM (SELECT src - src % 2 AS a, dst AS b, w FROM edges UNION ALL SELECT dst, src - src % 2, w FROM edges) WHERE a <> b GROUP BY a, b")
def graph_projection(t):
    e = edges(t).select((C("src") - C("src") % 2).alias("src"), "dst", "w")  # an odd node is the even one before it
    return graph.projection(e).select(C("src").alias("a"), C("dst").alias("b"), F.round("w", 6).alias("w"))


@query("graph_forgetting", f"WITH {EDGES}, d AS (SELECT *, (epoch(TIMESTAMP '1999-01-01') - epoch(last)) / 86400 AS idle, CASE WHEN n < 2 THEN 20.0 WHEN n < 5 THEN 45.0 WHEN n < 10 THEN 90.0 ELSE 180.0 END AS stability FROM edges) SELECT src, dst, round(CASE WHEN (n >= 5 AND w >= 0.3) OR exp(-idle / stability) >= 0.99 THEN w ELSE w * exp(-idle / stability) END, 6) AS w FROM d")
def graph_forgetting(t):
    idle = temporal.age_days(C("last"), F.expr("TIMESTAMP '1999-01-01'"))
    return edges(t).select("src", "dst", F.round(graph.forgotten(C("w"), C("n"), idle), 6).alias("w"))


@query("graph_prune", f"WITH {EDGES}, k AS (SELECT * FROM edges WHERE NOT (w < 0.05 AND n < 3 AND NOT (n >= 5 AND w >= 0.3))), nd AS (SELECT DISTINCT src AS node FROM edges) SELECT node, node NOT IN (SELECT src FROM k) AS orphan, (SELECT count(*) FROM k WHERE src = node AND n >= 5 AND w >= 0.3) AS lasting FROM nd")
def graph_prune(t):
    lasting = (C("n") >= 5) & (C("w") >= 0.3)
    e = edges(t).withColumn("kept", ~((C("w") < 0.05) & (C("n") < 3) & ~lasting))
    return e.groupBy(C("src").alias("node")).agg((F.count(F.when(C("kept"), 1)) == 0).alias("orphan"), F.count(F.when(C("kept") & lasting, 1)).alias("lasting"))


@query("graph_reinforce", f"WITH {EDGES} SELECT src, dst, round(1 - (1 - w) * pow(0.9, n), 6) AS w FROM edges")
def graph_reinforce(t):
    return edges(t).select("src", "dst", F.round(graph.reinforced(C("w"), C("n"), 0.1), 6).alias("w"))


@query("graph_merge", f"WITH {EDGES}, m AS (SELECT CASE WHEN src IN (7, 8, 9) THEN 7 ELSE src END AS src, dst, w FROM edges) SELECT src, dst, round(least(1.0, sum(w)), 6) AS w FROM m GROUP BY ALL")
def graph_merge(t):
    return graph.merged(edges(t), {8: 7, 9: 7}).select("src", "dst", F.round("w", 6).alias("w"))


@query("graph_pagerank")
def graph_pagerank(t):
    seeds = t.spark.createDataFrame([(3,), (4,)], "node long")
    return graph.pagerank(edges(t), seeds).select("node", F.round("activation", 5).alias("activation"))


@query("graph_communities")
def graph_communities(t):
    e = part_edges(t).where("w > 0.3").select(C("a").alias("src"), C("b").alias("dst"), "w")
    return graph.label_propagation(e)


@query("graph_capped_clusters")
def graph_capped_clusters(t):
    e = part_edges(t).where("w > 0.2").select(C("a").alias("src"), C("b").alias("dst"), "w")
    return graph.capped_clusters(e, 8)


@query("graph_degrees", f"WITH {PART_EDGES} SELECT node, count(*) AS degree, round(sum(w), 4) AS strength FROM (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY node")
def graph_degrees(t):
    e = part_edges(t)
    return e.select(C("a").alias("node"), "w").union(e.select("b", "w")).groupBy("node").agg(F.count("*").alias("degree"), F.round(F.sum("w"), 4).alias("strength"))
