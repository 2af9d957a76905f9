"""Queries that join: truth table, judgments, time windows, vectors, graph, tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import joins, pairs, retrieval
from palimpsest.plans.bindings import ATOMS, AUDIT, EDGES, FACTS, NOW, atoms, audit, duck_jaccard, duck_tokens, edges, facts, now_
from palimpsest.plans.registry import query

COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query("join_knn", f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({COS}, 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM s) SELECT qid, id, cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def join_knn(t):
    return joins.nearest_vectors(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), 10)


@query("join_knn_per_label", f"WITH s AS (SELECT a.vec_id AS qid, b.label AS label, b.vec_id AS id, round({COS}, 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id = 3), r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY cosine DESC, id) AS rank FROM s) SELECT qid, label, id, cosine FROM r WHERE rank <= 3")
def join_knn_per_label(t):
    from palimpsest.functions.vector import cosine

    q = t.embeddings.where("vec_id = 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    both = t.embeddings.join(F.broadcast(q), F.col("vec_id") != F.col("qid")).select("qid", "label", F.col("vec_id").alias("id"), F.round(cosine(F.col("q"), F.col("embedding")), 4).alias("cosine"))
    return joins.top_k(both, ["qid", "label"], [F.desc("cosine"), F.col("id")], 3).drop("rank")


@query("join_truth_layer", f"WITH {ATOMS} SELECT vec_id, label, tier, superseded_by IS NOT NULL AS old FROM embeddings LEFT JOIN atoms ON vec_id = id")
def join_truth_layer(t):
    return t.embeddings.select("vec_id", "label").join(atoms(t), F.col("vec_id") == F.col("id"), "left").select("vec_id", "label", "tier", F.col("superseded_by").isNotNull().alias("old"))


@query("join_supersessions", f"WITH {ATOMS} SELECT n.id AS new_id, o.id AS old_id, n.topic_key = o.topic_key AS same_topic FROM atoms n JOIN atoms o ON n.supersedes = o.id")
def join_supersessions(t):
    a = atoms(t)
    o = a.select(F.col("id").alias("old_id"), F.col("topic_key").alias("old_topic"))
    return a.where("supersedes IS NOT NULL").join(o, F.col("supersedes") == F.col("old_id")).select(F.col("id").alias("new_id"), "old_id", (F.col("topic_key") == F.col("old_topic")).alias("same_topic"))


@query("join_wrong_counts", f"WITH {AUDIT} SELECT a.atom, count(*) FILTER (quality = 0) AS wrong, count(*) FILTER (quality = 1) AS good FROM audit a JOIN labels ON a.atom = doc_id GROUP BY a.atom")
def join_wrong_counts(t):
    j = audit(t).where("atom IS NOT NULL").join(t.labels, F.col("atom") == F.col("doc_id"))
    return j.groupBy("atom").agg(F.count(F.when(F.col("quality") == 0, 1)).alias("wrong"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"))


@query("join_unlinked", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def join_unlinked(t):
    return t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("join_unsupported", f"WITH {ATOMS}, {AUDIT} SELECT id FROM atoms WHERE kind = 'conjecture' AND NOT EXISTS (SELECT 1 FROM audit WHERE atom = id AND outcome = 'right') ORDER BY created_at DESC, id LIMIT 60")
def join_unsupported(t):
    c = atoms(t).where("kind = 'conjecture'").select("id", "created_at")
    return c.join(audit(t).where("outcome = 'right'").select(F.col("atom").alias("id")), "id", "left_anti").orderBy(F.desc("created_at"), "id").limit(60).select("id")


@query("join_retention", f"WITH {AUDIT} SELECT event_id FROM events e WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY AND event_type NOT IN ('purchase', 'signup') AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = e.event_id)")
def join_retention(t):
    newest = t.events.agg(F.max("ts").alias("newest"))
    old = t.events.join(F.broadcast(newest)).where(F.col("ts") < F.col("newest") - F.expr("INTERVAL 3 DAY")).where(~F.col("event_type").isin("purchase", "signup"))
    return old.select("event_id").join(t.documents.select(F.col("doc_id").alias("event_id")), "event_id", "left_anti")


@query("join_label_sources", f"WITH {AUDIT}, x AS (SELECT event_id, outcome AS label, 'audit' AS source FROM audit WHERE outcome IS NOT NULL UNION ALL SELECT event_id, CASE quality WHEN 1 THEN 'right' ELSE 'wrong' END, 'sidecar' FROM audit JOIN labels ON atom = doc_id WHERE outcome IS NULL) SELECT source, label, count(*) AS n FROM x GROUP BY ALL")
def join_label_sources(t):
    a = audit(t)
    own = a.where("outcome IS NOT NULL").select("event_id", F.col("outcome").alias("label"), F.lit("audit").alias("source"))
    side = a.where("outcome IS NULL").join(t.labels, F.col("atom") == F.col("doc_id")).select("event_id", F.when(F.col("quality") == 1, "right").otherwise("wrong").alias("label"), F.lit("sidecar").alias("source"))
    return own.unionByName(side).groupBy("source", "label").agg(F.count("*").alias("n"))


@query("join_prior_edits", "SELECT a.event_id, b.event_id AS prior FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND epoch_us(a.ts) - epoch_us(b.ts) <= 3600 * CAST(1000000 AS BIGINT)")
def join_prior_edits(t):
    a = t.events.select("event_id", "user_id", "ts")
    b = t.events.select(F.col("event_id").alias("prior"), "user_id", F.col("ts").alias("prior_ts"))
    return joins.within_window(a, b, "ts", "prior_ts", 3600, ["user_id"]).where("prior_ts < ts").select("event_id", "prior")


@query("join_neighbours_in_time", "SELECT a.event_id, count(*) AS n, min(b.event_id) AS first FROM events a JOIN events b ON a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60 * 1000000 WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def join_neighbours_in_time(t):
    a = t.events.where("event_type = 'purchase'").select("event_id", "ts")
    b = t.events.select(F.col("event_id").alias("other"), F.col("ts").alias("other_ts"))
    return joins.within_window(a, b, "ts", "other_ts", 60).where("event_id <> other").groupBy("event_id").agg(F.count("*").alias("n"), F.min("other").alias("first"))


@query("join_restated", f"WITH c AS (SELECT conv_id, turn, {duck_tokens('text')} AS x FROM conversations WHERE role = 'user'), p AS (SELECT a.conv_id, a.turn, b.turn AS again, {duck_jaccard('a.x', 'b.x')} AS j FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 4) SELECT conv_id, turn, min(again) AS again FROM p WHERE j >= 0.05 GROUP BY conv_id, turn")
def join_restated(t):
    c = t.conversations.where("role = 'user'").select("conv_id", "turn", text.tokens(F.col("text")).alias("x"))
    b = c.select("conv_id", F.col("turn").alias("again"), F.col("x").alias("y"))
    p = c.join(b, "conv_id").where("again > turn AND again <= turn + 4").where(text.jaccard(F.col("x"), F.col("y")) >= 0.05)
    return p.groupBy("conv_id", "turn").agg(F.min("again").alias("again"))


@query("join_follow_ups", "WITH n AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) SELECT role, following, count(*) AS n, CAST(max(length(answer)) AS BIGINT) AS longest FROM n WHERE following IS NOT NULL GROUP BY ALL")
def join_follow_ups(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = t.conversations.select("role", F.lead("role").over(w).alias("following"), F.lead("text").over(w).alias("answer")).where("following IS NOT NULL")
    return n.groupBy("role", "following").agg(F.count("*").alias("n"), F.max(F.length("answer")).cast("long").alias("longest"))


@query("join_one_hop", f"WITH {EDGES} SELECT dst AS node, max(w) AS w FROM edges WHERE src IN (3, 4) GROUP BY dst")
def join_one_hop(t):
    return edges(t).where("src IN (3, 4)").groupBy(F.col("dst").alias("node")).agg(F.max("w").alias("w"))


BOTH = f"{EDGES}, both_ways AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"


@query("join_two_hops", f"WITH {BOTH}, one AS (SELECT dst AS node, max(w * 0.7) AS act FROM both_ways WHERE src IN (3, 4) GROUP BY dst), two AS (SELECT dst AS node, max(act * w * 0.5) AS act FROM both_ways JOIN one ON src = node GROUP BY dst) SELECT node, round(max(act), 6) AS activation FROM (FROM one UNION ALL FROM two) WHERE node NOT IN (3, 4) GROUP BY node")
def join_two_hops(t):
    seeds = t.spark.createDataFrame([(3,), (4,)], "node long")
    return joins.two_hops(edges(t), seeds).select("node", F.round("activation", 6).alias("activation"))


@query("join_entity_search", f"WITH {EDGES} SELECT src AS node, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS degree, arg_max(dst, row(n, dst)) AS nearest FROM edges GROUP BY src ORDER BY mentions DESC, node LIMIT 20")
def join_entity_search(t):
    a = edges(t).groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("mentions"), F.count("*").alias("degree"), F.max_by("dst", F.struct("n", "dst")).alias("nearest"))
    return a.orderBy(F.desc("mentions"), "node").limit(20)


@query("join_excluded", f"WITH {AUDIT} SELECT DISTINCT session FROM audit WHERE session NOT IN (SELECT session FROM audit WHERE route = 'purchase' AND latency > 60)")
def join_excluded(t):
    a = audit(t)
    return a.select("session").distinct().join(a.where("route = 'purchase' AND latency > 60").select("session"), "session", "left_anti")


@query("join_parent_expansion", "SELECT c.conv_id, c.turn, coalesce(p.text, c.text) = p.text AS swapped, CAST(length(coalesce(p.text, c.text)) AS BIGINT) AS n FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = 0")
def join_parent_expansion(t):
    p = t.conversations.where("turn = 0").select("conv_id", F.col("text").alias("parent"))
    x = F.coalesce("parent", "text")
    return t.conversations.join(p, "conv_id", "left").select("conv_id", "turn", (x == F.col("parent")).alias("swapped"), F.length(x).cast("long").alias("n"))


@query("join_contradictions", f"WITH {ATOMS}, p AS (SELECT a.id AS x, b.id AS y FROM atoms a JOIN atoms b ON a.topic_key = b.topic_key AND a.id < b.id AND a.speaker = b.speaker AND abs(a.confidence - b.confidence) > 0.5), s AS (SELECT x AS id FROM p UNION ALL SELECT y FROM p) SELECT id, count(*) AS pending FROM s GROUP BY id")
def join_contradictions(t):
    a = atoms(t).select("id", "topic_key", "speaker", "confidence")
    b = a.toDF("other", "topic_key", "speaker", "other_confidence")
    p = a.join(b, ["topic_key", "speaker"]).where("id < other").where(F.abs(F.col("confidence") - F.col("other_confidence")) > 0.5)
    return p.select(F.explode(F.array("id", "other")).alias("id")).groupBy("id").agg(F.count("*").alias("pending"))


@query("join_corroboration", f"WITH s AS (SELECT a.vec_id AS id, b.label, max({COS}) AS m FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL) SELECT id, CAST(round(least(1.0, 0.4 + 0.1 * count(*) FILTER (m >= 0.3)), 4) AS DOUBLE) AS trust FROM s GROUP BY id")
def join_corroboration(t):
    asked = pairs.asked(t.embeddings.where("vec_id % 20 = 0"))
    s = pairs.best_of_groups(asked, pairs.points(t.embeddings, "vec_id", "embedding", "label"), "label")
    return s.groupBy(F.col("qid").alias("id")).agg(F.round(F.least(F.lit(1.0), 0.4 + 0.1 * F.count(F.when(F.col("m") >= 0.3, 1))), 4).alias("trust"))


@query("join_conflicts", f"WITH {ATOMS}, n AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY created_at DESC, id) AS k FROM atoms), c AS (SELECT id, topic_key, {duck_tokens('text')} AS x, length(text) AS l FROM n WHERE k <= 12) SELECT a.id AS a, b.id AS b, round({duck_jaccard('a.x', 'b.x')}, 6) AS j FROM c a JOIN c b ON a.topic_key = b.topic_key AND a.id < b.id AND greatest(a.l, b.l) <= 2 * least(a.l, b.l) WHERE {duck_jaccard('a.x', 'b.x')} >= 0.05")
def join_conflicts(t):
    c = joins.top_k(atoms(t).select("id", "topic_key", "created_at", "text"), ["topic_key"], [F.desc("created_at"), F.col("id")], 12).select("id", "topic_key", text.tokens(F.col("text")).alias("x"), F.length("text").alias("l"))
    a, b = c.toDF("a", "topic_key", "ax", "al"), c.toDF("b", "topic_key", "bx", "bl")
    j = text.jaccard(F.col("ax"), F.col("bx"))
    return a.join(b, "topic_key").where("a < b AND greatest(al, bl) <= 2 * least(al, bl)").where(j >= 0.05).select("a", "b", F.round(j, 6).alias("j"))


@query("join_parallel_edges", f"WITH {EDGES} SELECT src - src % 2 AS src, dst, round(least(1.0, sum(w)), 6) AS w FROM edges GROUP BY src - src % 2, dst")
def join_parallel_edges(t):
    """An odd node is another name of the even one before it."""
    return edges(t).groupBy((F.col("src") - F.col("src") % 2).alias("src"), "dst").agg(F.round(F.least(F.lit(1.0), F.sum("w")), 6).alias("w"))


PART_EDGES = "e AS (SELECT a.l_partkey AS a, b.l_partkey AS b, least(1.0, sum(least(a.l_quantity, b.l_quantity)) / 100) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)"


def part_edges(t):
    """Parts that stand in one order, with how much of both was taken; an order has a handful of lines."""
    a = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_quantity").alias("q"))
    return a.join(a.toDF("l_orderkey", "b", "r"), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.least(F.lit(1.0), F.sum(F.least("q", "r")) / 100).alias("w"))


@query("join_triangles", f"WITH {PART_EDGES}, s AS (SELECT * FROM e WHERE w > 0.2) SELECT x.a, x.b, y.b AS c, round((x.w + y.w + z.w) / 3, 6) AS strength FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b ORDER BY (x.w + y.w + z.w) / 3 DESC, x.a, x.b, y.b LIMIT 10")
def join_triangles(t):
    found = joins.triangles(part_edges(t).where("w > 0.2"))
    return found.orderBy(F.desc("strength"), "a", "b", "c").limit(10).withColumn("strength", F.round("strength", 6))


@query("join_connections", f"WITH {EDGES} SELECT src, dst, round(w, 6) AS w FROM edges WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY edges.w DESC, n DESC, dst) <= 5")
def join_connections(t):
    return joins.top_k(edges(t).where("n >= 2"), ["src"], [F.desc("w"), F.desc("n"), F.col("dst")], 5).select("src", "dst", F.round("w", 6).alias("w"))


@query("join_provenance", f"WITH RECURSIVE e AS (SELECT doc_id AS child, doc_id // 3 AS parent FROM documents WHERE doc_id > 0), r AS (SELECT CAST(100 AS BIGINT) AS node, 0 AS hops UNION SELECT parent, hops + 1 FROM r JOIN e ON node = child WHERE hops < 8) SELECT node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY node")
def join_provenance(t):
    e = t.documents.where("doc_id > 0").select(F.col("doc_id").alias("child"), F.expr("doc_id div 3").alias("parent"))
    return joins.trace(e, t.spark.createDataFrame([(100,)], "node long"), 8)


@query("join_ready_tasks", "WITH d AS (SELECT o_orderkey AS task, unnest([o_orderkey // 2, o_orderkey // 3]) AS needs FROM orders WHERE o_orderstatus = 'O') SELECT DISTINCT o_orderkey AS task FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT task FROM d JOIN orders o ON o.o_orderkey = needs WHERE o.o_orderstatus <> 'F')")
def join_ready_tasks(t):
    o = t.orders.select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("status"))
    waiting = o.where("status = 'O'").select("task", F.explode(F.array(F.expr("task div 2"), F.expr("task div 3"))).alias("needs"))
    blocked = waiting.join(o.toDF("needs", "needed"), "needs").where("needed <> 'F'").select("task")
    return o.where("status = 'O'").select("task").join(blocked, "task", "left_anti")


@query("join_task_truth", "SELECT o_orderkey AS task, o_orderstatus AS status, count(l_linenumber) AS attempts, count(*) FILTER (l_linestatus = 'F') AS failed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def join_task_truth(t):
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("status")).agg(F.count("l_linenumber").alias("attempts"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("failed"))


@query("join_duplicate_decisions", "SELECT a.o_orderkey AS id, min(b.o_orderkey) AS earlier FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.o_orderkey <> a.o_orderkey AND b.o_orderdate <= a.o_orderdate AND epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate) <= 864000 * CAST(1000000 AS BIGINT) GROUP BY a.o_orderkey")
def join_duplicate_decisions(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("at"))
    b = t.orders.select(F.col("o_orderkey").alias("other"), "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("other_at"))
    return joins.within_window(a, b, "at", "other_at", 864000, ["o_custkey", "o_orderpriority"]).where("id <> other AND other_at <= at").groupBy("id").agg(F.min("other").alias("earlier"))


@query("join_contradiction_spread", f"WITH {ATOMS}, {AUDIT} SELECT event_id, atom FROM audit JOIN atoms ON atom = id WHERE superseded_by IS NOT NULL AND latency > 100")
def join_contradiction_spread(t):
    return audit(t).where("latency > 100").join(atoms(t).where("superseded_by IS NOT NULL").select("id"), F.col("atom") == F.col("id"), "left_semi").select("event_id", "atom")


@query("join_text_matches", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def join_text_matches(t):
    """A text that holds another has all of its tokens, but for the first and the last, which may go on in it."""
    b = t.benchmark.select("item_id", F.col("text").alias("probe"))
    q = b.select(F.col("item_id").alias("qid"), text.tokens(F.col("probe")).alias("q"))
    near = retrieval.shared_tokens(q, t.documents.select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("d"))).where("n >= nq - 2").select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"))
    short = joins.each_with_each(q.where("size(q) <= 2").select(F.col("qid").alias("item_id")), t.documents.select("doc_id"))
    return near.union(short).distinct().join(b, "item_id").join(t.documents.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("probe"))).select("item_id", "doc_id")


@query("join_near_edges", f"WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 4) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s) SELECT a, b, c FROM r WHERE k <= 3 AND 1 - c <= 0.8")
def join_near_edges(t):
    found = joins.nearest_vectors(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), 5).where("rank <= 3 AND 1 - cosine <= 0.8")
    return found.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.col("cosine").alias("c"))


@query("join_cluster_size", f"WITH s AS (SELECT a.vec_id AS id, round({COS}, 4) AS c, b.vec_id AS o FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, o) AS k FROM s) SELECT id, 1 + count(*) FILTER (c >= 0.3) AS cluster_size FROM r WHERE k <= 10 GROUP BY id")
def join_cluster_size(t):
    found = joins.nearest_vectors(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), 10)
    return found.groupBy(F.col("qid").alias("id")).agg((1 + F.count(F.when(F.col("cosine") >= 0.3, 1))).alias("cluster_size"))


@query("join_fact_overlap", f"WITH {FACTS} SELECT a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.entity = b.entity AND a.attribute <> b.attribute AND a.id < b.id AND a.value <> b.value AND a.valid_from <= coalesce(b.valid_to, TIMESTAMP '9999-01-01') AND b.valid_from <= coalesce(a.valid_to, TIMESTAMP '9999-01-01')")
def join_fact_overlap(t):
    f = facts(t).select("id", "entity", "attribute", "value", "valid_from", F.coalesce("valid_to", F.expr("TIMESTAMP '9999-01-01'")).alias("until"))
    b = f.toDF("b", "entity", "b_attribute", "b_value", "b_from", "b_until")
    return f.join(b, "entity").where("attribute <> b_attribute AND id < b AND value <> b_value AND valid_from <= b_until AND b_from <= until").select(F.col("id").alias("a"), "b")
