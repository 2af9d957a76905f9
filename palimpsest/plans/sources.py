"""Queries on snapshots, collectors, windows of streams, and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import evaluation, joins
from palimpsest.plans.bindings import ATOMS, AUDIT, NOW, atoms, audit, duck_tokens, now_
from palimpsest.plans.registry import query
from palimpsest.plans.windows import LISTS, ranked_lists
from palimpsest.sources import collectors, snapshot
from palimpsest.streaming import windows as streams

C = F.col


@query("src_scan", "SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND n_chars > 300 ORDER BY doc_id LIMIT 30 OFFSET 15")
def src_scan(t):
    return t.documents.where("lang = 'fr' AND n_chars > 300").orderBy("doc_id").offset(15).limit(30).select("doc_id", "lang")


@query("src_collections", f"WITH {ATOMS} SELECT collection, count(*) AS n FROM atoms GROUP BY collection")
def src_collections(t):
    return atoms(t).groupBy("collection").agg(F.count("*").alias("n"))


@query("src_upsert", "SELECT doc_id, lang, source FROM documents WHERE NOT (doc_id % 9 = 0) UNION ALL SELECT doc_id, 'xx', source FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id + 10000000, 'new', source FROM documents WHERE doc_id % 9 = 1")
def src_upsert(t):
    base = t.documents.select("doc_id", "lang", "source")
    batch = base.where("doc_id % 9 = 0").withColumn("lang", F.lit("xx")).unionByName(base.where("doc_id % 9 = 1").withColumns({"doc_id": C("doc_id") + 10000000, "lang": F.lit("new")}))
    return snapshot.upsert(base, batch, "doc_id")


@query("src_patch", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 10 = 0 THEN 'moved' ELSE source END AS source FROM documents")
def src_patch(t):
    base = t.documents.select("doc_id", "lang", "source")
    changes = base.where("doc_id % 2 = 0").select("doc_id", F.when(C("doc_id") % 6 == 0, "xx").alias("lang"), F.when(C("doc_id") % 10 == 0, "moved").alias("source"))
    return snapshot.patch(base, changes, "doc_id")


@query("src_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def src_delete(t):
    return snapshot.delete(t.documents.select("doc_id"), t.labels.where("toxic = 1"), "doc_id")


@query("src_alias", f"WITH {ATOMS} SELECT id FROM atoms WHERE collection = 'experience' AND kind = 'decision'")
def src_alias(t):
    return atoms(t).where("collection = 'experience'").where("kind = 'decision'").select("id")


@query("src_append_new", "WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), b AS (SELECT * FROM h WHERE doc_id % 2 = 0), n AS (SELECT h, min(doc_id) AS doc_id FROM h WHERE doc_id % 2 = 1 GROUP BY h) SELECT h, doc_id FROM n WHERE h NOT IN (SELECT h FROM b)")
def src_append_new(t):
    h = t.documents.select("doc_id", F.md5("text").alias("h"))
    return snapshot.append_new(h.where("doc_id % 2 = 0"), h.where("doc_id % 2 = 1"), "h", [C("doc_id")])


@query("src_index_changes", "WITH o AS (SELECT doc_id, md5(text) AS v FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END AS v FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'add' WHEN n.doc_id IS NULL THEN 'remove' WHEN o.v = n.v THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def src_index_changes(t):
    v = t.documents.select("doc_id", F.md5("text").alias("v"))
    new = v.where("doc_id % 11 <> 0").withColumn("v", F.when(C("doc_id") % 5 == 0, "x").otherwise(C("v")))
    return snapshot.index_changes(v.where("doc_id % 7 <> 0"), new, "doc_id", "v")


@query("src_command_buckets", "SELECT user_id, CAST(epoch(time_bucket(INTERVAL 15 MINUTE, ts)) AS BIGINT) AS bucket, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY ALL")
def src_command_buckets(t):
    g = t.events.groupBy("user_id", F.window(C("ts").cast("timestamp"), "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return g.select("user_id", C("w.start").cast("long").alias("bucket"), "n", "kinds")


@query("src_workflow_segments", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600 * CAST(1000000 AS BIGINT) OR event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM g) SELECT user_id, CAST(segment AS BIGINT) AS segment, min(event_type) AS kind, count(*) AS n FROM s GROUP BY user_id, segment")
def src_workflow_segments(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(C("ts").cast("timestamp"))
    new = F.when(F.lag("ts").over(w).isNull() | (at - F.lag(at).over(w) > 3600_000_000) | (C("event_type") != F.lag("event_type").over(w)), 1).otherwise(0)
    s = t.events.withColumn("nw", new).withColumn("segment", F.sum("nw").over(w))
    return s.groupBy("user_id", "segment").agg(F.min("event_type").alias("kind"), F.count("*").alias("n"))


@query("src_visits", "WITH u AS (SELECT url FROM pages UNION ALL SELECT 'https://user@www.' || s_name || '.example.org:8080/' || s_suppkey AS url FROM supplier UNION ALL SELECT 'http://m.' || c_mktsegment || '.example.net?x' FROM customer), d AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS domain FROM u) SELECT domain, count(*) AS n FROM d WHERE NOT regexp_matches(domain, '^m\\.') GROUP BY domain")
def src_visits(t):
    """Three histories: pages, and addresses made of suppliers and of customers' segments."""
    supplier = t.supplier.select(F.concat(F.lit("https://user@www."), "s_name", F.lit(".example.org:8080/"), C("s_suppkey").cast("string")).alias("url"))
    segment = t.customer.select(F.concat(F.lit("http://m."), "c_mktsegment", F.lit(".example.net?x")).alias("url"))
    visits = t.pages.select("url").unionByName(supplier).unionByName(segment)
    d = visits.select(text.domain(C("url")).alias("domain")).where(~C("domain").rlike(r"^m\."))
    return d.groupBy("domain").agg(F.count("*").alias("n"))


@query("src_messages", "SELECT user_id AS contact, CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS said FROM events WHERE event_type <> 'error' GROUP BY ALL")
def src_messages(t):
    g = t.events.where("event_type <> 'error'").groupBy(C("user_id").alias("contact"), F.to_date("ts").cast("string").alias("day"))
    return g.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))["event_type"], ",").alias("said"))


@query("src_calendar", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-05-01' AND TIMESTAMP '1996-06-15'")
def src_calendar(t):
    return t.orders.where(C("o_orderdate").between(F.expr("TIMESTAMP '1996-05-01'"), F.expr("TIMESTAMP '1996-06-15'"))).select("o_orderkey")


@query("src_active_contacts", "SELECT c_custkey, count(o_orderkey) AS sent, count(*) FILTER (o_orderstatus = 'F') AS received, count(DISTINCT o_orderpriority) AS kinds FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def src_active_contacts(t):
    j = t.customer.select("c_custkey").join(t.orders, C("c_custkey") == C("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("sent"), F.count(F.when(C("o_orderstatus") == "F", 1)).alias("received"), F.countDistinct("o_orderpriority").alias("kinds"))


@query("src_latest_per_day", "SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
def src_latest_per_day(t):
    e = t.events.select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", "ts")
    return snapshot.latest(e, ["user_id", "day"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "day", "event_id")


@query("src_state_changes", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def src_state_changes(t):
    e = t.events.select("event_id", "event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    return e.where("before IS NULL OR before <> event_type").select("event_id")


@query("src_manifest", "SELECT conv_id AS document_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, md5(string_agg(md5(text), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def src_manifest(t):
    g = t.conversations.groupBy(C("conv_id").alias("document_id")).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars"), F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))).alias("x"))
    return g.select("document_id", "chunks", "chars", F.md5(F.array_join(C("x.m"), "")).alias("digest"))


@query("src_embed_cache", "WITH k AS (SELECT doc_id, md5(concat('model', ':', substr(text, 1, 1200))) AS k FROM documents) SELECT doc_id, k IN (SELECT k FROM k WHERE doc_id % 2 = 0) AS hit FROM k")
def src_embed_cache(t):
    k = t.documents.select("doc_id", F.md5(F.concat(F.lit("model:"), F.substring("text", 1, 1200))).alias("k"))
    cached = k.where("doc_id % 2 = 0").select("k").distinct().withColumn("hit", F.lit(True))
    return k.join(cached, "k", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("src_eviction", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY ORDER BY ts DESC, event_id DESC LIMIT 1000")
def src_eviction(t):
    newest = t.events.agg(F.max("ts").alias("newest"))
    return t.events.join(F.broadcast(newest)).where(C("ts") >= C("newest") - F.expr("INTERVAL 5 DAY")).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")


@query("src_chunks")
def src_chunks(t):
    return collectors.chunks(t.documents, "doc_id", "text").select("doc_id", "chunk_no", "chunk_id", F.length("chunk").alias("n"))


@query("src_notes")
def src_notes(t):
    head = F.to_json(F.struct(C("source").alias("title"), "lang"))
    raw = t.documents.select(F.concat(F.lit("n"), C("doc_id").cast("string")).alias("path"), F.when(C("doc_id") % 5 == 0, C("text")).otherwise(F.concat(F.lit("---\n"), head, F.lit("\n---\n"), "text")).alias("text"))
    return collectors.parsed_notes(raw).select("path", C("head")["title"].alias("title"), F.length("body").alias("n"))


@query("src_shell_history", "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS at, user_id % 10 AS seconds, concat(event_type, ' ', event_id) AS command FROM events")
def src_shell_history(t):
    lines = t.events.select(F.concat(F.lit(": "), F.unix_seconds(C("ts").cast("timestamp")).cast("string"), F.lit(":"), (C("user_id") % 10).cast("string"), F.lit(";"), "event_type", F.lit(" "), C("event_id").cast("string")).alias("value"))
    return collectors.shell_history(lines)


# -- windows of streams, as tables


def metric_events(t):
    return audit(t).select(C("ts").cast("timestamp").alias("ts"), "route", "latency", F.when(C("route") == "error", 1).otherwise(0).alias("error"), "session")


@query("stream_rolling", f"WITH {AUDIT}, w AS (SELECT route, latency, unnest([time_bucket(INTERVAL 10 MINUTE, ts), time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 20 MINUTE]) AS start FROM audit) SELECT CAST(epoch(start) AS BIGINT) AS start, route, count(*) AS n, count(*) FILTER (route = 'error') AS errors, round(avg(latency), 4) AS latency FROM w GROUP BY ALL")
def stream_rolling(t):
    w = streams.rolling(metric_events(t))
    return w.select(C("start").cast("long").alias("start"), "route", "n", "errors", F.round("latency", 4).alias("latency"))


@query("stream_sessions", f"WITH {AUDIT}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, event_id) >= 1800 * CAST(1000000 AS BIGINT) THEN 1 ELSE 0 END AS nw FROM audit), s AS (SELECT *, sum(nw) OVER (PARTITION BY session ORDER BY ts, event_id) AS k FROM g) SELECT session, CAST(epoch(min(ts)) AS DOUBLE) AS start, count(*) AS n FROM s GROUP BY session, k")
def stream_sessions(t):
    return streams.session_counts(metric_events(t)).select("session", C("start").cast("double").alias("start"), "n")


@query("stream_high_watermark", f"WITH {AUDIT}, m AS (SELECT route, max(ts) AS mark FROM audit WHERE outcome = 'ignored' AND session % 2 = 0 GROUP BY route) SELECT event_id FROM audit LEFT JOIN m USING (route) WHERE outcome IS NOT NULL AND (mark IS NULL OR ts > mark)")
def stream_high_watermark(t):
    """What came after the mark that the last run left for its route; where no run left one, all."""
    a = audit(t)
    marks = a.where("outcome = 'ignored' AND session % 2 = 0").groupBy("route").agg(F.max("ts").alias("mark"))
    return a.where("outcome IS NOT NULL").join(marks, "route", "left").where("mark IS NULL OR ts > mark").select("event_id")


@query("stream_cooldown", f"WITH {AUDIT} SELECT event_id FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session, route ORDER BY ts, event_id) AS d FROM audit) WHERE d IS NULL OR d >= 7200 * CAST(1000000 AS BIGINT)")
def stream_cooldown(t):
    at = F.unix_micros(C("ts").cast("timestamp"))
    d = audit(t).select("event_id", (at - F.lag(at).over(Window.partitionBy("session", "route").orderBy("ts", "event_id"))).alias("d"))
    return d.where("d IS NULL OR d >= 7200000000").select("event_id")


@query("stream_slo", f"WITH {AUDIT} SELECT route, round(avg(latency), 4) AS actual, avg(latency) > 50 AS breach FROM audit GROUP BY route")
def stream_slo(t):
    return audit(t).groupBy("route").agg(F.avg("latency").alias("a")).select("route", F.round("a", 4).alias("actual"), (C("a") > 50).alias("breach"))


# -- evaluation

HITS = f"{LISTS}, rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s / den, 9) DESC, id) AS rank FROM f JOIN den USING (qid)), top AS (SELECT qid, id, rank FROM rk WHERE rank <= 5), hit AS (SELECT b.item_id AS qid, min(rank) FILTER (contains(d.text, b.text)) AS rank FROM benchmark b LEFT JOIN top ON b.item_id = qid LEFT JOIN documents d ON d.doc_id = id GROUP BY b.item_id)"


def hits(t):
    from palimpsest.operators import fusion

    fused = fusion.rrf(ranked_lists(t), {"jaccard": 0.9, "cover": 1.0})
    top = joins.top_k(fused, ["qid"], [F.desc(F.round(C("score") / 100, 9)), C("id")], 5)
    cases = t.benchmark.select(C("item_id").alias("qid"), C("text").alias("expected"))
    found = cases.join(top, "qid", "left").join(t.documents.select(C("doc_id").alias("id"), "text"), "id", "left")
    return found.groupBy("qid").agg(F.min(F.when(C("text").contains(C("expected")), C("rank"))).alias("rank"))


@query("eval_hits", f"WITH {HITS} SELECT qid, CAST(coalesce(rank, 0) AS BIGINT) AS rank FROM hit")
def eval_hits(t):
    return hits(t).select("qid", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


@query("eval_summary", f"WITH {HITS} SELECT count(*) AS n, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg, round(avg(rank), 6) AS mean_rank FROM hit")
def eval_summary(t):
    rank = F.coalesce(C("rank"), F.lit(0))
    return hits(t).agg(F.count("*").alias("n"), F.round(F.avg(F.when(rank > 0, 1.0).otherwise(0.0)), 6).alias("hit_at_5"), F.round(F.avg(evaluation.reciprocal_rank(rank)), 6).alias("mrr"), F.round(F.avg(evaluation.ndcg_at(rank, 5)), 6).alias("ndcg"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@query("eval_forbidden", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON d.source = concat('src', item_id % 20) AND contains(lower(d.text), lower(b.text))")
def eval_forbidden(t):
    b = t.benchmark.select("item_id", F.concat(F.lit("src"), (C("item_id") % 20).cast("string")).alias("source"), F.lower("text").alias("bad"))
    return t.documents.join(b, "source").where(F.lower("text").contains(C("bad"))).select("item_id", "doc_id")


@query("eval_loose", f"WITH q AS (SELECT item_id, {duck_tokens('text')} AS q FROM benchmark), d AS (SELECT doc_id, {duck_tokens('text')} AS d FROM documents), e AS (SELECT item_id, unnest(q) AS tok FROM q) SELECT item_id, doc_id FROM q JOIN d ON len(list_intersect(q, d)) >= greatest(1, CAST(floor(0.75 * len(q)) AS INT)) AND len(q) > 0")
def eval_loose(t):
    q = t.benchmark.select("item_id", text.tokens(C("text")).alias("q")).where("size(q) > 0")
    d = t.documents.select("doc_id", text.tokens(C("text")).alias("d"))
    need = F.greatest(F.lit(1), F.floor(0.75 * F.size("q")))
    shared = q.select("item_id", need.alias("need"), F.explode("q").alias("tok")).join(d.select("doc_id", F.explode("d").alias("tok")), "tok")
    return shared.groupBy("item_id", "doc_id", "need").agg(F.count("*").alias("n")).where("n >= need").select("item_id", "doc_id")


@query("eval_calibration", f"WITH {ATOMS} SELECT tier, round(avg(pow(1 / (1 + exp(-(1.5 * confidence - 0.7))) - quality_label, 2)), 6) AS brier FROM (SELECT tier, confidence, l.quality AS quality_label FROM atoms JOIN labels l ON id = doc_id) GROUP BY tier")
def eval_calibration(t):
    j = atoms(t).select("id", "tier", "confidence").join(t.labels.select(C("doc_id").alias("id"), "quality"), "id")
    p = 1 / (1 + F.exp(-(1.5 * C("confidence") - 0.7)))
    return j.groupBy("tier").agg(F.round(F.avg(F.pow(p - C("quality"), 2)), 6).alias("brier"))


@query("eval_failures", f"WITH {HITS} SELECT CASE WHEN rank IS NULL THEN 'missing' WHEN rank > 3 THEN 'low' ELSE 'fine' END AS bucket, count(*) AS n FROM hit GROUP BY 1")
def eval_failures(t):
    return hits(t).groupBy(F.when(C("rank").isNull(), "missing").when(C("rank") > 3, "low").otherwise("fine").alias("bucket")).agg(F.count("*").alias("n"))


@query("eval_recall_gaps", f"WITH {LISTS} SELECT qid, round(max(100 * s / den), 2) AS best FROM f JOIN den USING (qid) GROUP BY qid HAVING max(100 * s / den) < 99.5")
def eval_recall_gaps(t):
    from palimpsest.operators import fusion

    best = fusion.rrf(ranked_lists(t), {"jaccard": 0.9, "cover": 1.0}).groupBy("qid").agg(F.max("score").alias("best"))
    return best.where("best < 99.5").select("qid", F.round("best", 2).alias("best"))


@query("eval_contract_audit", f"WITH {ATOMS}, k AS (SELECT collection, unnest(list_filter([CASE WHEN trust IS NULL THEN 'trust' END, CASE WHEN valid_until IS NULL THEN 'valid_until' END], lambda x: x IS NOT NULL)) AS missing FROM atoms) SELECT collection, missing, count(*) AS n FROM k GROUP BY ALL")
def eval_contract_audit(t):
    keys = F.array_compact(F.array(*[F.when(C(k).isNull(), F.lit(k)) for k in ("trust", "valid_until")]))
    return atoms(t).select("collection", F.explode(keys).alias("missing")).groupBy("collection", "missing").agg(F.count("*").alias("n"))


@query("eval_freshness", f"WITH {ATOMS} SELECT path, CAST(epoch({NOW}) - epoch(max(created_at)) AS BIGINT) AS age, epoch({NOW}) - epoch(max(created_at)) > 5 * 86400 AS late FROM atoms GROUP BY path")
def eval_freshness(t):
    age = now_().cast("timestamp").cast("long") - F.max("created_at").cast("timestamp").cast("long")
    return atoms(t).groupBy("path").agg(age.alias("age")).withColumn("late", C("age") > 5 * 86400)


@query("eval_calibration_fit")
def eval_calibration_fit(t):
    j = atoms(t).select("id", "confidence").join(t.labels.select(C("doc_id").alias("id"), "quality"), "id")
    a, b = evaluation.logistic_fit(j, "confidence", "quality")
    return t.spark.createDataFrame([(a, b)], "a double, b double")
