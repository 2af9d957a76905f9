"""Queries on sequences, ranks, sets and packing of results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.vector import cosine
from palimpsest.operators import fusion, joins, retrieval, setjoin, windows
from palimpsest.plans.bindings import ATOMS, AUDIT, EDGES, NOW, OUTCOMES, atoms, audit, duck_jaccard, duck_tokens, edges, outcomes, now_
from palimpsest.plans.registry import query



@query("win_edge_dedup", f"WITH {EDGES}, e AS (SELECT src - src % 2 AS src, dst, w, n FROM edges) SELECT src, dst, round(w, 6) AS w, n FROM e QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY e.w DESC, n DESC) = 1")
def win_edge_dedup(t):
    e = edges(t).select((F.col("src") - F.col("src") % 2).alias("src"), "dst", "w", "n")  # an odd node is the even one before it
    return joins.top_k(e, ["src", "dst"], [F.desc("w"), F.desc("n")], 1).select("src", "dst", F.round("w", 6).alias("w"), "n")


GAP = "g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800 * CAST(1000000 AS BIGINT) THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g)"


@query("win_sessions", f"WITH {GAP} SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n, min(event_id) AS first FROM s GROUP BY ALL")
def win_sessions(t):
    return windows.sessions(t.events, ["user_id"], "ts", "event_id", 1800).groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("win_sessions_capped", f"WITH {GAP}, c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) - 1) // 2 AS part FROM s) SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY session_no, part) - 1 AS session_no, event_id FROM c")
def win_sessions_capped(t):
    return windows.sessions(t.events, ["user_id"], "ts", "event_id", 1800, most=2).select("user_id", F.col("session_no").cast("long").alias("session_no"), "event_id")


@query("win_newest_per_topic", f"WITH {ATOMS} SELECT topic_key, id FROM atoms QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY created_at DESC, id) <= 12")
def win_newest_per_topic(t):
    return joins.top_k(atoms(t).select("topic_key", "id", "created_at"), ["topic_key"], [F.desc("created_at"), F.col("id")], 12).select("topic_key", "id")


@query("win_source_cap", "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) > 3 AS over_cap, lang FROM documents) SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY over_cap, n_chars DESC, doc_id) AS rank FROM r")
def win_source_cap(t):
    found = windows.capped_last(t.documents.select("doc_id", "lang", "source", "n_chars"), ["lang"], "source", [F.desc("n_chars"), F.col("doc_id")], 3)
    return found.select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query("win_run_delta", "WITH d AS (SELECT event_type AS track, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL) SELECT track, CAST(day AS STRING) AS day, round(v - lag(v) OVER (PARTITION BY track ORDER BY day), 9) AS delta FROM d")
def win_run_delta(t):
    d = t.events.groupBy(F.col("event_type").alias("track"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return d.select("track", F.col("day").cast("string").alias("day"), F.round(F.col("v") - F.lag("v").over(Window.partitionBy("track").orderBy("day")), 9).alias("delta"))


@query("win_baseline", "WITH d AS (SELECT event_type AS track, date_trunc('hour', ts) AS h, count(*) AS v FROM events GROUP BY ALL), m AS (SELECT track, max(h) AS latest FROM d GROUP BY track) SELECT d.track, CAST(epoch(arg_min(h, abs(epoch(h) - epoch(latest - INTERVAL 24 HOUR)) * 1000000 + epoch(h) / 10000)) AS BIGINT) AS base FROM d JOIN m ON d.track = m.track WHERE abs(epoch(h) - epoch(latest - INTERVAL 24 HOUR)) <= 7200 GROUP BY d.track")
def win_baseline(t):
    d = t.events.groupBy(F.col("event_type").alias("track"), F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("v"))
    m = d.groupBy("track").agg(F.max("h").alias("latest"))
    off = F.abs(F.col("h").cast("timestamp").cast("long") - (F.col("latest").cast("timestamp").cast("long") - 86400))
    return d.join(m, "track").where(off <= 7200).groupBy("track").agg(F.min(F.struct(off.alias("off"), F.col("h").cast("timestamp").cast("long").alias("h")))["h"].alias("base"))


@query("win_declines", "WITH d AS (SELECT event_type AS track, CAST(ts AS DATE) AS day, count(*) AS v FROM events GROUP BY ALL), l AS (SELECT *, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c FROM d WINDOW w AS (PARTITION BY track ORDER BY day)) SELECT track, CAST(day AS STRING) AS day FROM l WHERE v < a AND a < b AND b < c")
def win_declines(t):
    d = t.events.groupBy(F.col("event_type").alias("track"), F.to_date("ts").alias("day")).agg(F.count("*").alias("v"))
    w = Window.partitionBy("track").orderBy("day")
    lagged = d.select("track", "day", "v", *[F.lag("v", k).over(w).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "c"))])
    return lagged.where("v < a AND a < b AND b < c").select("track", F.col("day").cast("string").alias("day"))


@query("win_failing_jobs", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') >= 4 AS urgent FROM r WHERE k <= 5 GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') >= 2")
def win_failing_jobs(t):
    r = joins.top_k(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    a = r.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    return a.where("errors >= 2").withColumn("urgent", F.col("errors") >= 4)


@query("win_breaches", "WITH b AS (SELECT user_id, event_id, ts, value > 50 AS breach, CASE WHEN (value > 50) IS NOT DISTINCT FROM lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 0 ELSE 1 END AS ch FROM events), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n FROM i WHERE breach GROUP BY ALL HAVING count(*) >= 3")
def win_breaches(t):
    b = t.events.select("user_id", "event_id", "ts", (F.col("value") > 50).alias("breach"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.when(F.lag("breach").over(w).eqNullSafe(F.col("breach")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    i = b.withColumn("ch", changed).withColumn("island", F.sum("ch").over(w))
    return i.where("breach").groupBy("user_id", "island").agg(F.count("*").alias("n")).where("n >= 3")


@query("win_percentiles", "WITH s AS (SELECT event_type AS route, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type HAVING count(*) >= 20) SELECT route, v[CAST(least(len(v) - 1, floor(len(v) * 0.5)) AS BIGINT) + 1] AS p50, v[CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS BIGINT) + 1] AS p95, v[CAST(least(len(v) - 1, floor(len(v) * 0.99)) AS BIGINT) + 1] AS p99 FROM s")
def win_percentiles(t):
    """By rank and count, so that no group's values are gathered in one row."""
    w = Window.partitionBy("event_type")
    r = t.events.where("value IS NOT NULL").select("event_type", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("k"))
    n = t.events.where("value IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n")).where("n >= 20")
    at = lambda p: F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))), F.col("value")))
    return r.join(n, "event_type").groupBy(F.col("event_type").alias("route")).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("win_sliding_p95", "WITH s AS (SELECT user_id, event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1800 SECOND PRECEDING AND CURRENT ROW)) AS v FROM events WHERE value IS NOT NULL) SELECT user_id, event_id, v[CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS BIGINT) + 1] AS p95 FROM s")
def win_sliding_p95(t):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-1800 * 1_000_000, 0)
    s = t.events.where("value IS NOT NULL").select("user_id", "event_id", F.sort_array(F.collect_list("value").over(w)).alias("v"))
    return s.select("user_id", "event_id", windows.index_percentile(F.col("v"), 0.95).alias("p95"))


@query("win_edit_outcome", "WITH n AS (SELECT user_id, event_id, event_type, lead(event_type) OVER w AS nxt, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN nxt IS NULL THEN 'final' WHEN nxt = event_type AND d < 600 * CAST(1000000 AS BIGINT) THEN 'refined' WHEN nxt = 'error' THEN 'reverted' ELSE 'superseded' END AS outcome FROM n")
def win_edit_outcome(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    n = t.events.select("event_id", "event_type", F.lead("event_type").over(w).alias("nxt"), (F.lead(at).over(w) - at).alias("d"))
    outcome = F.when(F.col("nxt").isNull(), "final").when((F.col("nxt") == F.col("event_type")) & (F.col("d") < 600_000_000), "refined").when(F.col("nxt") == "error", "reverted").otherwise("superseded")
    return n.select("event_id", outcome.alias("outcome"))


@query("win_keep_newest", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def win_keep_newest(t):
    return joins.top_k(t.events.select("event_id", "event_type", "ts"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id")


@query("win_preference_evolution", f"WITH {ATOMS} SELECT id, lag(id) OVER (PARTITION BY topic_key ORDER BY created_at, id) AS before, round(confidence - lag(confidence) OVER (PARTITION BY topic_key ORDER BY created_at, id), 6) AS moved FROM atoms WHERE kind = 'preference'")
def win_preference_evolution(t):
    w = Window.partitionBy("topic_key").orderBy("created_at", "id")
    return atoms(t).where("kind = 'preference'").select("id", F.lag("id").over(w).alias("before"), F.round(F.col("confidence") - F.lag("confidence").over(w), 6).alias("moved"))


@query("win_knowledge_diff", f"WITH {ATOMS} SELECT change, count(*) AS n FROM (SELECT CASE WHEN supersedes IS NULL THEN 'added' ELSE 'changed' END AS change FROM atoms WHERE created_at >= TIMESTAMP '2024-06-01' AND created_at < TIMESTAMP '2024-09-01' UNION ALL SELECT 'removed' FROM atoms WHERE valid_until >= TIMESTAMP '2024-06-01' AND valid_until < TIMESTAMP '2024-09-01') GROUP BY change")
def win_knowledge_diff(t):
    a = atoms(t)
    inside = lambda c: (F.col(c) >= F.expr("TIMESTAMP '2024-06-01'")) & (F.col(c) < F.expr("TIMESTAMP '2024-09-01'"))
    born = a.where(inside("created_at")).select(F.when(F.col("supersedes").isNull(), "added").otherwise("changed").alias("change"))
    gone = a.where(inside("valid_until")).select(F.lit("removed").alias("change"))
    return born.unionByName(gone).groupBy("change").agg(F.count("*").alias("n"))


@query("win_timetravel", f"WITH {ATOMS} SELECT collection, kind, count(*) AS n FROM atoms WHERE created_at <= TIMESTAMP '2024-08-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-08-01') GROUP BY ALL")
def win_timetravel(t):
    from palimpsest.functions.temporal import valid_at

    return atoms(t).where(valid_at(F.col("created_at"), F.col("valid_until"), F.expr("TIMESTAMP '2024-08-01'"))).groupBy("collection", "kind").agg(F.count("*").alias("n"))


# -- top-k


@query("topk_final", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def topk_final(t):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("topk_attention", f"WITH {OUTCOMES}, a AS (SELECT domain, avg(confidence) AS s, count(*) AS n, avg(CASE WHEN overridden THEN 1.0 ELSE 0.0 END) AS v FROM outcomes GROUP BY domain) SELECT domain, round(s * (1 / (1 + (n % 9) / 3.0)) * greatest(0.7, least(1.3, 1 + 0.3 * (1 - 2 * v))), 6) AS priority FROM a ORDER BY s * (1 / (1 + (n % 9) / 3.0)) * greatest(0.7, least(1.3, 1 + 0.3 * (1 - 2 * v))) DESC, domain LIMIT 10")
def topk_attention(t):
    a = outcomes(t).groupBy("domain").agg(F.avg("confidence").alias("s"), F.count("*").alias("n"), F.avg(F.when(F.col("overridden"), 1.0).otherwise(0.0)).alias("v"))
    p = F.col("s") * (1 / (1 + (F.col("n") % 9) / 3.0)) * F.greatest(F.lit(0.7), F.least(F.lit(1.3), 1 + 0.3 * (1 - 2 * F.col("v"))))
    return a.withColumn("p", p).orderBy(F.desc("p"), "domain").limit(10).select("domain", F.round("p", 6).alias("priority"))


@query("topk_decay_filter", f"WITH {AUDIT} SELECT a.event_id FROM audit a WHERE NOT EXISTS (SELECT 1 FROM audit b WHERE b.session = a.session AND b.atom = a.atom AND b.event_id < a.event_id AND a.event_id - b.event_id <= 2000)")
def topk_decay_filter(t):
    w = Window.partitionBy("session", "atom").orderBy("event_id")
    a = audit(t).withColumn("seen", F.lag("event_id").over(w))
    return a.where("atom IS NULL OR seen IS NULL OR event_id - seen > 2000").select("event_id")


@query("topk_sample", f"WITH {ATOMS} SELECT id FROM atoms WHERE confidence >= 0.6 AND created_at < {NOW} - INTERVAL 7 DAY ORDER BY md5(concat(CAST(id AS STRING), ':7')), id LIMIT 32")
def topk_sample(t):
    old = atoms(t).where("confidence >= 0.6").where(F.col("created_at") < now_() - F.expr("INTERVAL 7 DAY"))
    return old.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":7"))), "id").limit(32).select("id")


@query("topk_hot_entities", f"WITH {EDGES} SELECT dst AS node, CAST(sum(n) AS BIGINT) AS n FROM edges GROUP BY dst ORDER BY n DESC, node LIMIT 15")
def topk_hot_entities(t):
    return edges(t).groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(15)


@query("topk_safety_cap", f"WITH {ATOMS}, c AS (SELECT id FROM atoms WHERE valid_until < TIMESTAMP '2024-02-20'), g AS (SELECT (SELECT count(*) FROM c) <= least(50, greatest(1, 0.05 * (SELECT count(*) FROM atoms))) AS go) SELECT id, CASE WHEN id IN (SELECT id FROM c) AND go THEN 'obsolete' ELSE tier END AS tier FROM atoms, g")
def topk_safety_cap(t):
    a = atoms(t)
    due = F.coalesce(F.col("valid_until") < F.expr("TIMESTAMP '2024-02-20'"), F.lit(False))
    gate = a.agg(F.count(F.when(due, 1)).alias("c"), F.count("*").alias("n")).select((F.col("c") <= F.least(F.lit(50), F.greatest(F.lit(1), 0.05 * F.col("n")))).alias("go"))
    return a.join(F.broadcast(gate)).select("id", F.when(due & F.col("go"), "obsolete").otherwise(F.col("tier")).alias("tier"))


# -- sets and fusion

LISTS = (
    f"q AS (SELECT item_id, {duck_tokens('text')} AS q FROM benchmark), d AS (SELECT doc_id, source, {duck_tokens('text')} AS d FROM documents), "
    f"s AS (SELECT item_id AS qid, doc_id AS id, round({duck_jaccard('q', 'd')}, 6) AS a, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, d)) AS DOUBLE) / len(q) END, 6) AS b FROM q, d), "
    "v AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS c FROM embeddings a JOIN benchmark ON item_id = a.vec_id JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), "
    "l AS (SELECT qid, id, 'jaccard' AS source, row_number() OVER (PARTITION BY qid ORDER BY a DESC, id) - 1 AS rank FROM s WHERE a > 0 UNION ALL SELECT qid, id, 'cover', row_number() OVER (PARTITION BY qid ORDER BY b DESC, id) - 1 FROM s WHERE b > 0 "
    "UNION ALL SELECT qid, id, 'dense', row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) - 1 FROM v WHERE c > 0), "
    "k AS (SELECT *, CASE source WHEN 'jaccard' THEN 0.9 ELSE 1.0 END AS weight FROM l WHERE rank < 30), den AS (SELECT qid, sum(weight) / 60 AS den FROM (SELECT DISTINCT qid, source, weight FROM k) GROUP BY qid), f AS (SELECT qid, id, sum(weight / (60 + rank)) AS s FROM k GROUP BY ALL)"
)


def ranked_lists(t):
    """qid, id, source, score, rank from 0: for every question two lists by shared tokens and one by vectors, which are
    compared within the question's label."""
    q = t.benchmark.select(F.col("item_id").alias("qid"), text.tokens(F.col("text")).alias("q"))
    d = t.documents.select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("d"))
    shared = retrieval.shared_tokens(q, d)
    s = shared.select("qid", "id", F.round(F.col("n") / (F.col("nq") + F.col("nd") - F.col("n")), 6).alias("jaccard"), F.round(F.col("n") / F.col("nq"), 6).alias("cover"))
    both = s.select("qid", "id", F.explode(F.create_map(F.lit("jaccard"), "jaccard", F.lit("cover"), "cover")).alias("source", "score")).where("score > 0")
    a = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("x"))
    v = a.join(t.embeddings, "label").where("vec_id <> qid").select("qid", F.col("vec_id").alias("id"), F.lit("dense").alias("source"), F.round(cosine(F.col("x"), F.col("embedding")), 4).alias("score")).where("score > 0")
    return joins.top_k(both.unionByName(v), ["qid", "source"], [F.desc("score"), F.col("id")], 30).withColumn("rank", F.col("rank") - 1)


@query("set_rrf", f"WITH {LISTS} SELECT qid, id, round(least(100, greatest(0, 100 * s / den)), 2) AS score FROM f JOIN den USING (qid)")
def set_rrf(t):
    return fusion.rrf(ranked_lists(t), {"jaccard": 0.9, "cover": 1.0}).select("qid", "id", F.round("score", 2).alias("score"))


@query("hybrid_recall", f"WITH {LISTS}, r AS (SELECT qid, id, least(100, greatest(0, 100 * s / den)) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s / den, 9) DESC, id) AS rank FROM f JOIN den USING (qid)) SELECT qid, id, round(score, 2) AS score, rank FROM r WHERE rank <= 10")
def hybrid_recall(t):
    fused = fusion.rrf(ranked_lists(t), {"jaccard": 0.9, "cover": 1.0})
    top = joins.top_k(fused, ["qid"], [F.desc(F.round(F.col("score") / 100, 9)), F.col("id")], 10)
    return top.select("qid", "id", F.round("score", 2).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("set_content_dedup", "WITH k AS (SELECT doc_id, n_chars, md5(concat_ws('|', source, substr(text, 1, 500)))[1:16] AS key FROM documents) SELECT key, doc_id FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) = 1")
def set_content_dedup(t):
    k = t.documents.select("doc_id", "n_chars", text.content_key(F.col("source"), F.col("text")).alias("key"))
    return joins.top_k(k, ["key"], [F.desc("n_chars"), F.col("doc_id")], 1).select("key", "doc_id")


@query("set_exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def set_exact_dedup(t):
    return t.documents.groupBy(F.md5("text").alias("m")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("m")


@query("set_contained", f"WITH d AS (SELECT doc_id, source, {duck_tokens('text')} AS x FROM documents WHERE n_chars < 400) SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id AND len(a.x) > 0 AND len(b.x) > 0 AND CAST(len(list_intersect(a.x, b.x)) AS DOUBLE) / least(len(a.x), len(b.x)) >= 0.5")
def set_contained(t):
    d = t.documents.where("n_chars < 400").select(F.col("doc_id").alias("id"), "source", text.tokens(F.col("text")).alias("tokens"))
    return setjoin.pairs_of_ids(*setjoin.alike(d, 0.5, "containment", ("source",)))


@query("set_id_union", "SELECT DISTINCT id FROM (SELECT doc_id AS id FROM labels WHERE quality = 1 UNION SELECT vec_id FROM embeddings WHERE label = 3)")
def set_id_union(t):
    return t.labels.where("quality = 1").select(F.col("doc_id").alias("id")).union(t.embeddings.where("label = 3").select("vec_id")).distinct()


@query("set_activation_merge", f"WITH {EDGES} SELECT node, round(max(w), 6) AS w FROM (SELECT src AS node, w FROM edges UNION ALL SELECT dst, w * 0.5 FROM edges) GROUP BY node")
def set_activation_merge(t):
    e = edges(t)
    return e.select(F.col("src").alias("node"), "w").unionByName(e.select(F.col("dst").alias("node"), (F.col("w") * 0.5).alias("w"))).groupBy("node").agg(F.round(F.max("w"), 6).alias("w"))


@query("set_belief_diff", f"WITH {ATOMS} SELECT 'new' AS signal, count(*) AS n FROM atoms WHERE created_at >= {NOW} - INTERVAL 30 DAY UNION ALL SELECT 'superseded', count(*) FROM atoms WHERE superseded_by IS NOT NULL UNION ALL SELECT 'expired', count(*) FROM atoms WHERE valid_until < {NOW} UNION ALL SELECT 'due', count(*) FROM atoms WHERE next_review < {NOW}")
def set_belief_diff(t):
    signals = {"new": F.col("created_at") >= now_() - F.expr("INTERVAL 30 DAY"), "superseded": F.col("superseded_by").isNotNull(), "expired": F.col("valid_until") < now_(), "due": F.col("next_review") < now_()}
    one = atoms(t).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in signals.items()])
    return one.select(F.explode(F.create_map(*[x for n in signals for x in (F.lit(n), F.col(n))])).alias("signal", "n"))


@query("set_self_eval", "WITH a AS (SELECT source, list(doc_id) AS x FROM (SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 10) GROUP BY source), b AS (SELECT source, list(doc_id) AS y FROM (SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) <= 10) GROUP BY source) SELECT source, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) AS j FROM a JOIN b USING (source)")
def set_self_eval(t):
    d = t.documents.select("source", "doc_id", "n_chars", F.length("text").alias("l"))
    a, b = (joins.top_k(d, ["source"], [F.desc(c), F.col("doc_id")], 10).groupBy("source").agg(F.collect_list("doc_id").alias(n)) for c, n in (("n_chars", "x"), ("l", "y")))
    return a.join(b, "source").select("source", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("j"))


@query("set_greedy_dedup")
def set_greedy_dedup(t):
    """The 200 longest of a source; keep what no kept one of the last 80 resembles (Jaccard over 0.8)."""
    d = t.documents.select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), text.tokens(F.col("text")).alias("tokens"))
    first = joins.top_k(d, ["qid"], [F.desc("score"), F.col("id")], 200).drop("rank")
    return fusion.greedy_dedup(first, 0.8, 80).select("qid", "id")


@query("topk_mmr")
def topk_mmr(t):
    q = ranked_lists(t)
    fused = joins.top_k(fusion.rrf(q, {"jaccard": 0.9, "cover": 1.0}), ["qid"], [F.desc("score"), F.col("id")], 40)
    d = t.documents.select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    return fusion.mmr(fused.join(d, "id").select("qid", "id", "score", "tokens"), 10)


@query("topk_budget")
def topk_budget(t):
    d = t.documents.select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("priority"), (F.col("doc_id") % 97).cast("double").alias("score"), F.col("n_chars").alias("tokens"))
    first = joins.top_k(d, ["qid"], [F.col("priority"), F.desc("score"), F.col("id")], 200).drop("rank")
    return fusion.budget(first, 6000)
