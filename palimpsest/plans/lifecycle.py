"""Queries on the life of memories: promotion, pruning, conflicts, retention; lists of records; chunks; growth; evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text, timewords
from palimpsest.operators import joins, setjoin, state
from palimpsest.plans.bindings import ATOMS, AUDIT, EDGES, NOW, OUTCOMES, atoms, audit, duck_jaccard, duck_tokens, edges, now_, outcomes
from palimpsest.plans.governance import FUSED, fused
from palimpsest.plans.registry import query
from palimpsest.sources import chunks

C = F.col

# -- state


@query("state_cls_promotion", f"WITH {ATOMS}, {AUDIT}, f AS (SELECT atom, count(*) AS n FROM audit WHERE atom IS NOT NULL GROUP BY atom), s AS (SELECT DISTINCT session, atom FROM audit WHERE atom IS NOT NULL), co AS (SELECT a.atom, b.atom AS other, count(*) AS n FROM s a JOIN s b ON a.session = b.session AND a.atom <> b.atom GROUP BY ALL), st AS (SELECT atom, count(*) AS strong FROM co WHERE n >= 2 GROUP BY atom) SELECT id FROM atoms JOIN f ON f.atom = id JOIN st ON st.atom = id WHERE tier = 'episodic' AND confidence >= 0.6 AND f.n >= 5 AND strong >= 2")
def state_cls_promotion(t):
    """Sure, often used, and used together with at least two others time and again."""
    log = audit(t).where("atom IS NOT NULL")
    f = log.groupBy(C("atom").alias("id")).agg(F.count("*").alias("n")).where("n >= 5")
    due = atoms(t).where("tier = 'episodic' AND confidence >= 0.6").select("id").join(f, "id").select("id")
    s = log.select("session", "atom").distinct()
    own = s.join(due.withColumnRenamed("id", "atom"), "atom", "left_semi")
    co = own.join(s.withColumnRenamed("atom", "other"), "session").where("atom <> other").groupBy("atom", "other").agg(F.count("*").alias("n")).where("n >= 2")
    return co.groupBy(C("atom").alias("id")).agg(F.count("*").alias("strong")).where("strong >= 2").select("id")


@query("state_prune_atrophied", f"WITH {ATOMS}, c AS (SELECT id FROM atoms WHERE tier = 'obsolete' AND accesses < 20 AND created_at < {NOW} - INTERVAL 120 DAY AND coalesce(trust, 0.0) < 0.5 AND id NOT IN (SELECT supersedes FROM atoms WHERE supersedes IS NOT NULL)), n AS (SELECT (SELECT count(*) FROM c) AS due, (SELECT count(*) FROM atoms) AS every) SELECT id FROM c, n WHERE due <= 0.05 * every ORDER BY id LIMIT 100")
def state_prune_atrophied(t):
    """What is obsolete, hardly used, old, little trusted and not referred to; nothing at all if that is over 5 %, and 100
    at most, which is the operator's safety floor."""
    a = atoms(t)
    c = a.where("tier = 'obsolete' AND accesses < 20 AND coalesce(trust, 0.0) < 0.5").where(C("created_at") < now_() - F.expr("INTERVAL 120 DAY"))
    c = c.select("id").join(a.where("supersedes IS NOT NULL").select(C("supersedes").alias("id")), "id", "left_anti")
    gate = c.agg(F.count("*").alias("due")).crossJoin(a.agg(F.count("*").alias("every"))).where("due <= 0.05 * every")  # one row each
    return c.crossJoin(F.broadcast(gate)).orderBy("id").limit(100).select("id")


VERDICT = "CASE WHEN n.id IS NULL THEN 'dismiss' WHEN o.tier = 'obsolete' AND n.tier <> 'obsolete' THEN 'keep_new' WHEN n.tier = 'obsolete' AND o.tier <> 'obsolete' THEN 'keep_old' WHEN j >= 0.70 THEN 'keep_new' WHEN n.quality - o.quality >= 0.25 THEN 'keep_new' WHEN o.quality - n.quality >= 0.25 THEN 'keep_old' WHEN n.confidence - o.confidence > 0.20 THEN 'keep_new' WHEN o.confidence - n.confidence > 0.20 THEN 'keep_old' ELSE 'review' END"


def conflict_actions(t):
    """The first rule that holds settles a pair: a missing side, an inactive one, a rephrasing, authority, confidence."""
    a = atoms(t)
    p = a.where("supersedes IS NOT NULL").select(C("supersedes").alias("old_id"), C("id").alias("new_id")).union(a.where("superseded_by IS NOT NULL").select("id", "superseded_by")).distinct()
    side = lambda s: a.select(C("id").alias(f"{s}_id"), C("tier").alias(f"{s}_tier"), C("quality").alias(f"{s}_quality"), C("confidence").alias(f"{s}_confidence"), text.tokens(C("text")).alias(f"{s}_x"))
    m = p.join(side("old"), "old_id").join(side("new"), "new_id", "left")
    gone = lambda s: C(f"{s}_tier") == "obsolete"
    gap, surer = C("new_quality") - C("old_quality"), C("new_confidence") - C("old_confidence")
    action = F.when(C("new_tier").isNull(), "dismiss").when(gone("old") & ~gone("new"), "keep_new").when(gone("new") & ~gone("old"), "keep_old").when(text.jaccard(C("old_x"), C("new_x")) >= 0.70, "keep_new")
    action = action.when(gap >= 0.25, "keep_new").when(-gap >= 0.25, "keep_old").when(surer > 0.20, "keep_new").when(-surer > 0.20, "keep_old").otherwise("review")
    return m.select("old_id", "new_id", action.alias("action"))


@query("state_conflict_policy", f"WITH {ATOMS}, x AS (SELECT *, {duck_tokens('text')} AS x FROM atoms), p AS (SELECT supersedes AS old_id, id AS new_id FROM atoms WHERE supersedes IS NOT NULL UNION SELECT id, superseded_by FROM atoms WHERE superseded_by IS NOT NULL), m AS (SELECT old_id, new_id, {duck_jaccard('o.x', 'n.x')} AS j FROM p JOIN x o ON o.id = old_id LEFT JOIN x n ON n.id = new_id) SELECT old_id, new_id, {VERDICT} AS action FROM m JOIN atoms o ON o.id = old_id LEFT JOIN atoms n ON n.id = new_id")
def state_conflict_policy(t):
    return conflict_actions(t)


@query("state_auto_resolve", f"WITH {AUDIT}, v AS (SELECT atom, outcome, count(*) AS n FROM audit WHERE atom IS NOT NULL AND outcome IN ('right', 'wrong') GROUP BY ALL), w AS (SELECT atom, sum(n) AS votes, max(n) AS most, max(CASE outcome WHEN 'right' THEN n ELSE 0 END) AS yes, max(CASE outcome WHEN 'wrong' THEN n ELSE 0 END) AS no FROM v GROUP BY atom) SELECT atom, CASE WHEN votes >= 3 AND most >= 2 AND yes <> no THEN CASE WHEN yes > no THEN 'keep_new' ELSE 'keep_old' END ELSE 'pending' END AS action FROM w")
def state_auto_resolve(t):
    """Votes first: three at least, two of them alike; what they don't settle stays for the policy."""
    w = audit(t).where("atom IS NOT NULL").groupBy("atom").agg(F.count(F.when(C("outcome") == "right", 1)).alias("yes"), F.count(F.when(C("outcome") == "wrong", 1)).alias("no")).where("yes + no > 0")
    settled = (C("yes") + C("no") >= 3) & (F.greatest("yes", "no") >= 2) & (C("yes") != C("no"))
    return w.select("atom", F.when(settled, F.when(C("yes") > C("no"), "keep_new").otherwise("keep_old")).otherwise("pending").alias("action"))


VALENCE = """
WITH RECURSIVE e AS (
    SELECT user_id AS atom, CASE event_type WHEN 'error' THEN -10000 WHEN 'purchase' THEN 10000 ELSE 2500 END AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events
), f AS (
    SELECT atom, k, CAST(delta AS BIGINT) AS v FROM e WHERE k = 1
    UNION ALL
    SELECT atom, k, q + CASE WHEN 2 * r > k OR (2 * r = k AND q % 2 <> 0) THEN 1 ELSE 0 END FROM (
        SELECT atom, k, r, (x - r) // k AS q FROM (SELECT atom, k, x, (x % k + k) % k AS r FROM (SELECT f.atom, e.k, f.v * f.k + e.delta AS x FROM f JOIN e ON e.atom = f.atom AND e.k = f.k + 1))
    )
)
SELECT atom, arg_max(v, k) / 10000 AS valence, max(k) AS events FROM f GROUP BY atom
"""


@query("state_valence", VALENCE)
def state_valence(t):
    e = t.events.select(C("user_id").alias("atom"), "event_id", F.when(C("event_type") == "error", -1.0).when(C("event_type") == "purchase", 1.0).otherwise(0.25).alias("delta"))
    return state.valence(e)


# -- lists of records


@query("flt_notes_by_domain", f"WITH {ATOMS} SELECT id FROM atoms WHERE collection = 'canonical' AND path = 'src3'")
def flt_notes_by_domain(t):
    return atoms(t).where("collection = 'canonical' AND path = 'src3'").select("id")


@query("flt_pending_events", f"WITH {AUDIT} SELECT event_id FROM audit WHERE outcome IS NULL AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND route = 'click'")
def flt_pending_events(t):
    return audit(t).where("outcome IS NULL AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND route = 'click'").select("event_id")


@query("flt_tasks", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def flt_tasks(t):
    own = t.customer.where("c_nationkey = 3").select(C("c_custkey").alias("o_custkey"))
    return t.orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").join(own, "o_custkey", "left_semi").select(C("o_orderkey").alias("id"))


@query("flt_decisions", f"WITH {OUTCOMES} SELECT domain, id FROM outcomes WHERE overridden AND reason = 'late' AND confidence < 0.95")
def flt_decisions(t):
    return outcomes(t).where("overridden AND reason = 'late' AND confidence < 0.95").select("domain", "id")


@query("flt_context_noise", "SELECT page_id, trim(html) = '' OR regexp_matches(trim(html), '^<') OR (length(html) - length(regexp_replace(html, '<[^>]*>', '', 'g'))) >= 0.3 * length(html) AS noise FROM pages")
def flt_context_noise(t):
    """Empty, markup from the start, or markup for a third of it."""
    plain = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    return t.pages.select("page_id", ((F.trim("html") == "") | F.trim("html").rlike("^<") | (F.length("html") - plain >= 0.3 * F.length("html"))).alias("noise"))


@query("flt_test_writes", f"WITH {ATOMS} SELECT id FROM atoms WHERE NOT (speaker IN ('src1', 'src2') OR regexp_matches(lower(text), '\\b(pytest|smoke test|dummy)\\b'))")
def flt_test_writes(t):
    """Only what no test run wrote is kept."""
    return atoms(t).where(~(C("speaker").isin("src1", "src2") | F.lower("text").rlike(r"\b(pytest|smoke test|dummy)\b"))).select("id")


@query("flt_counterfactual", f"WITH {OUTCOMES} SELECT domain, id, max(reason = 'wrong') AS failed FROM outcomes WHERE ts >= (SELECT max(ts) FROM outcomes) - INTERVAL 14 DAY AND (reason = 'wrong' OR confidence < 0.95) GROUP BY domain, id")
def flt_counterfactual(t):
    """Recent decisions that failed or were unsure."""
    o = outcomes(t)
    last = o.agg(F.max("ts").alias("last"))
    recent = o.crossJoin(F.broadcast(last)).where("ts >= last - INTERVAL 14 DAY AND (reason = 'wrong' OR confidence < 0.95)")
    return recent.groupBy("domain", "id").agg(F.max(C("reason") == "wrong").alias("failed"))


@query("src_export", f"WITH {ATOMS} SELECT id, topic_key, kind, tier, round(confidence, 6) AS confidence, CAST(epoch(created_at) AS BIGINT) AS created FROM atoms")
def src_export(t):
    return atoms(t).select("id", "topic_key", "kind", "tier", F.round("confidence", 6).alias("confidence"), C("created_at").cast("timestamp").cast("long").alias("created"))


@query("src_reembed", "SELECT doc_id, md5(concat('model-2:', substr(text, 1, 1200))) AS key FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 8)")
def src_reembed(t):
    """What the shadow collection lacks, with the key of its new embedding, of 1,200 characters as the cache has it."""
    have = t.embeddings.where("label < 8").select(C("vec_id").alias("doc_id"))
    return t.documents.join(have, "doc_id", "left_anti").select("doc_id", F.md5(F.concat(F.lit("model-2:"), F.substring("text", 1, 1200))).alias("key"))


@query("src_recent_gate", f"WITH d AS (SELECT doc_id, source, {duck_tokens('text')} AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT DISTINCT a.doc_id FROM d a JOIN d b ON a.source = b.source AND b.k BETWEEN a.k - 50 AND a.k - 1 WHERE {duck_jaccard('a.x', 'b.x')} >= 0.7")
def src_recent_gate(t):
    """Records that resemble one of the 50 before them in their inbox."""
    d = t.documents.select(C("doc_id").alias("id"), "source", text.tokens(C("text")).alias("tokens"))
    return setjoin.like_recent(d, "source", 50, 0.7).select(C("id").alias("doc_id")).distinct()


# -- chunks and texts


@query("fn_frontmatter", "SELECT doc_id, md5(regexp_replace(concat(CASE WHEN doc_id % 2 = 0 THEN concat('---', chr(10), 'source: ', source, chr(10), '---', chr(10)) ELSE '' END, text), '^---(json)?\\s*\\n(.|\\n)*?\\n---\\s*\\n', '')) AS body FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def fn_frontmatter(t):
    d = t.documents.where("text IS NOT NULL AND source IS NOT NULL")
    note = F.concat(F.when(C("doc_id") % 2 == 0, F.concat(F.lit("---\nsource: "), "source", F.lit("\n---\n"))).otherwise(""), "text")
    return d.select("doc_id", F.md5(chunks.without_frontmatter(note)).alias("body"))


def notes(t):
    """A markdown note per document: a heading at every sentence's end."""
    return t.documents.where("text IS NOT NULL").select("doc_id", F.concat(F.lit("intro text that is long enough to be kept as a chunk of its own, it is.\n# Head "), C("doc_id").cast("string"), F.lit("\n"), F.replace("text", F.lit(". "), F.lit(".\n## Part\n"))).alias("note"))


@query("fn_heading_chunks")
def fn_heading_chunks(t):
    return chunks.by_heading(notes(t), "doc_id", "note")


@query("fn_merged_sections")
def fn_merged_sections(t):
    return chunks.merged_sections(chunks.by_heading(notes(t), "doc_id", "note"), "doc_id", target=700, most=1500)


@query("fn_dated_chunks")
def fn_dated_chunks(t):
    dated = t.documents.where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n2024-05-01 ")).alias("note"))
    return chunks.by_date(dated, "doc_id", "note")


@query("fn_boundaries", "WITH d AS (SELECT user_id, event_id, coalesce(value, 0) AS v FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM d), c AS (SELECT user_id, v AS least FROM n WHERE k = greatest(1, CAST(floor(n * 10 / 100) AS INT))) SELECT user_id, event_id FROM d JOIN c USING (user_id) WHERE v >= least")
def fn_boundaries(t):
    """Where the distance to the next is among the largest tenth."""
    d = t.events.select("user_id", "event_id", F.coalesce("value", F.lit(0.0)).alias("v"))
    w = Window.partitionBy("user_id")
    n = d.withColumn("k", F.row_number().over(w.orderBy(F.desc("v"), "event_id"))).withColumn("n", F.count("*").over(w))
    c = n.where(C("k") == F.greatest(F.lit(1), F.floor(C("n") * 10 / 100))).select("user_id", C("v").alias("least"))
    return d.join(c, "user_id").where("v >= least").select("user_id", "event_id")


#: A phrase of each row's own numbers, at the end of its whole text; its time is a day a turn after the year's start.
PHRASED = """CASE conv_id % 6 WHEN 0 THEN concat(turn + 1, ' days ago') WHEN 1 THEN 'Last week' WHEN 2 THEN 'this month' WHEN 3 THEN 'last wednesday' WHEN 4 THEN '2024-05-06' ELSE 'never' END"""
SPANS = f"""
WITH c AS (SELECT conv_id, turn, conv_id % 6 AS k, TIMESTAMP '2025-01-01 10:00:00' + to_days(CAST(turn AS INT)) AS now FROM conversations)
SELECT conv_id, turn,
    CASE k WHEN 0 THEN now - to_days(CAST(turn + 1 AS INT)) WHEN 1 THEN date_trunc('week', now) - to_days(7) WHEN 2 THEN date_trunc('month', now)
        WHEN 3 THEN date_trunc('day', now) - to_days(CAST((isodow(now) + 3) % 7 + 1 AS INT)) WHEN 4 THEN TIMESTAMP '2024-05-06' END AS since,
    CASE k WHEN 0 THEN now - to_days(CAST(turn AS INT)) WHEN 1 THEN date_trunc('week', now) WHEN 2 THEN date_trunc('month', now) + to_months(1)
        WHEN 3 THEN date_trunc('day', now) - to_days(CAST((isodow(now) + 3) % 7 AS INT)) WHEN 4 THEN TIMESTAMP '2024-05-07' END AS until
FROM conversations JOIN c USING (conv_id, turn)
"""


@query("fn_time_expressions", SPANS)
def fn_time_expressions(t):
    """What stretch of time each whole text speaks of, from its own row's time."""
    now = F.expr("timestampadd(DAY, CAST(turn AS INT), TIMESTAMP '2025-01-01 10:00:00')")
    s = timewords.spoken_of(F.concat_ws(" ", "text", F.expr(PHRASED)), now)
    return t.conversations.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.since", "s.until")


# -- streams and growth


@query("stream_retention", f"WITH {AUDIT}, n AS (SELECT max(ts) AS last FROM audit) SELECT route, count(*) AS dropped FROM audit, n WHERE ts < last - to_hours(CASE route WHEN 'error' THEN 14 WHEN 'click' THEN 30 ELSE 60 END) GROUP BY route")
def stream_retention(t):
    """Each class of rows has its own age; the ages are parameters (here hours)."""
    a = audit(t)
    last = a.agg(F.max("ts").alias("last"))
    hours = F.when(C("route") == "error", 14).when(C("route") == "click", 30).otherwise(60)
    old = F.unix_micros(C("ts").cast("timestamp")) < F.unix_micros(C("last").cast("timestamp")) - hours * F.lit(3_600_000_000)
    return a.crossJoin(F.broadcast(last)).where(old).groupBy("route").agg(F.count("*").alias("dropped"))


@query("stream_habituation", f"WITH {AUDIT} SELECT session, route, count(*) AS shown FROM audit GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (outcome = 'right') = 0")
def stream_habituation(t):
    """What was shown again and again and never helped."""
    return audit(t).groupBy("session", "route").agg(F.count("*").alias("shown"), F.count(F.when(C("outcome") == "right", 1)).alias("helped")).where("shown >= 3 AND helped = 0").select("session", "route", "shown")


@query("stream_insight_ttl", f"WITH {AUDIT}, l AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY session, route ORDER BY ts, event_id) AS before FROM audit) SELECT event_id FROM l WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 6 * 3600 * 1000000::BIGINT")
def stream_insight_ttl(t):
    """An insight is told again only if its like was not told within six hours."""
    before = F.lag("ts").over(Window.partitionBy("session", "route").orderBy("ts", "event_id"))
    gap = F.unix_micros(C("ts").cast("timestamp")) - F.unix_micros(C("before").cast("timestamp"))
    return audit(t).withColumn("before", before).where(C("before").isNull() | (gap > 6 * 3600 * 1_000_000)).select("event_id")


@query("stream_semantic_cache", "WITH q AS (SELECT conv_id, turn, md5(lower(trim(text))) AS k FROM conversations), l AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY k ORDER BY conv_id, turn) AS before FROM q) SELECT conv_id, turn, before IS NOT NULL AS cached FROM l")
def stream_semantic_cache(t):
    """A question asked before is answered from the cache."""
    k = F.md5(F.lower(F.trim("text")))
    before = F.lag("turn").over(Window.partitionBy("k").orderBy("conv_id", "turn"))
    return t.conversations.withColumn("k", k).withColumn("before", before).select("conv_id", "turn", C("before").isNotNull().alias("cached"))


GROWTH = "arg_max(coalesce(value, 0), CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id % 1000000) - arg_min(coalesce(value, 0), CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id % 1000000)"


def growth(t, *by):
    """Last value less first, per group."""
    order = F.struct("ts", (C("event_id") % 1_000_000).alias("e"))
    v = F.coalesce("value", F.lit(0.0))
    return t.events.groupBy(*by).agg(F.round(F.max_by(v, order) - F.min_by(v, order), 4).alias("grown"), F.count("*").alias("n"))


@query("win_rss_growth", f"SELECT user_id, date_trunc('hour', ts) AS hour, round({GROWTH}, 4) AS grown FROM events GROUP BY ALL HAVING count(*) >= 2")
def win_rss_growth(t):
    """Growth within an hour, of one process."""
    return growth(t, "user_id", F.date_trunc("hour", "ts").alias("hour")).where("n >= 2").drop("n")


@query("win_log_growth", f"SELECT event_type, CAST(ts AS DATE) AS day, round({GROWTH}, 4) AS grown FROM events GROUP BY ALL")
def win_log_growth(t):
    return growth(t, "event_type", F.to_date("ts").alias("day")).drop("n")


# -- entities, evaluation, batches


@query("agg_entity_mentions", "WITH m AS (SELECT unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{3,}')) AS name, doc_id FROM documents) SELECT lower(name) AS name, count(*) AS mentions, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_seen FROM m GROUP BY 1")
def agg_entity_mentions(t):
    m = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\b[A-Z][a-z]{3,})"), F.lit(1))).alias("name"))
    return m.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_seen"))


@query("eval_training_pairs", f"WITH {FUSED}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM fused), h AS (SELECT r.*, contains(d.text, b.text) AS hit FROM r JOIN documents d ON d.doc_id = r.id JOIN benchmark b ON b.item_id = qid) SELECT p.qid, p.id AS positive, n.id AS negative FROM (SELECT qid, id FROM h WHERE hit QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k) = 1) p JOIN (SELECT qid, id FROM h WHERE NOT hit QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k) <= 3) n ON p.qid = n.qid")
def eval_training_pairs(t):
    """A question's best hit, with the three best rows that miss as hard negatives."""
    r = fused(t).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    r = r.join(t.documents.select(C("doc_id").alias("id"), "text"), "id").join(t.benchmark.select(C("item_id").alias("qid"), C("text").alias("asked")), "qid")
    h = r.select("qid", "id", "k", C("text").contains(C("asked")).alias("hit"))
    p = joins.top_k(h.where("hit"), ["qid"], [C("k")], 1).select("qid", C("id").alias("positive"))
    return p.join(joins.top_k(h.where("NOT hit"), ["qid"], [C("k")], 3).select("qid", C("id").alias("negative")), "qid")


@query("eval_sweep_decision", f"WITH {AUDIT}, m AS (SELECT actor, avg(CASE WHEN outcome = 'right' THEN 1.0 ELSE 0.0 END) AS hit, avg(latency) AS ms FROM audit GROUP BY actor), b AS (SELECT hit AS bh, ms AS bm FROM m WHERE actor = 0) SELECT actor, CASE WHEN hit < bh - 0.005 THEN 'revert' WHEN ms > 1.1 * bm THEN 'revert' WHEN hit > bh + 0.005 THEN 'keep' ELSE 'neutral' END AS decision FROM m, b WHERE actor <> 0")
def eval_sweep_decision(t):
    m = audit(t).groupBy("actor").agg(F.avg(F.when(C("outcome") == "right", 1.0).otherwise(0.0)).alias("hit"), F.avg("latency").alias("ms"))
    b = m.where("actor = 0").select(C("hit").alias("bh"), C("ms").alias("bm"))
    decision = F.when(C("hit") < C("bh") - 0.005, "revert").when(C("ms") > 1.1 * C("bm"), "revert").when(C("hit") > C("bh") + 0.005, "keep").otherwise("neutral")
    return m.where("actor <> 0").crossJoin(F.broadcast(b)).select("actor", decision.alias("decision"))


@query("qry_batch_recall", f"WITH {FUSED} SELECT qid // 20 AS batch, qid, id FROM fused QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5")
def qry_batch_recall(t):
    """Questions in batches of 20, answered together."""
    top = joins.top_k(fused(t), ["qid"], [F.desc("score"), C("id")], 5)
    return top.select(F.floor(C("qid") / 20).cast("long").alias("batch"), "qid", "id")


@query("graph_seeds", f"WITH {EDGES}, n AS (SELECT DISTINCT src AS node FROM edges), w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-zé]+')) AS w FROM conversations) SELECT DISTINCT conv_id, turn, node FROM (SELECT conv_id, turn, length(w) AS len FROM w) JOIN n ON node = len")
def graph_seeds(t):
    """Nodes that a question names, by whole word; a word's length stands for its node."""
    n = edges(t).select(C("src").alias("node")).distinct()
    w = t.conversations.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-zé]+)"), F.lit(1))).alias("w"))
    return w.select("conv_id", "turn", F.length("w").cast("long").alias("node")).join(n, "node").select("conv_id", "turn", "node").distinct()


@query("graph_session_activation", f"WITH {AUDIT}, n AS (SELECT session, max(ts) AS last FROM audit GROUP BY session) SELECT a.session, atom, count(*) AS n FROM audit a JOIN n ON a.session = n.session AND epoch_us(last) - epoch_us(ts) <= 90 * 60 * 1000000::BIGINT WHERE atom IS NOT NULL GROUP BY a.session, atom")
def graph_session_activation(t):
    """What a session touched within its last stretch of time (a parameter, here 90 minutes) is still active."""
    a = audit(t)
    last = a.groupBy("session").agg(F.max("ts").alias("last"))
    fresh = F.unix_micros(C("last").cast("timestamp")) - F.unix_micros(C("ts").cast("timestamp")) <= 90 * 60 * 1_000_000
    return a.where("atom IS NOT NULL").join(last, "session").where(fresh).groupBy("session", "atom").agg(F.count("*").alias("n"))


@query("rank_proposals", f"WITH {ATOMS} SELECT id, CAST(CASE WHEN accesses >= 2 THEN 22 WHEN accesses = 1 THEN 12 ELSE 0 END + floor(confidence * 35) + CASE collection WHEN 'canonical' THEN 15 WHEN 'knowledge' THEN 12 ELSE 8 END AS BIGINT) AS score FROM atoms WHERE kind = 'conjecture'")
def rank_proposals(t):
    sources = F.when(C("accesses") >= 2, 22).when(C("accesses") == 1, 12).otherwise(0)
    domain = F.when(C("collection") == "canonical", 15).when(C("collection") == "knowledge", 12).otherwise(8)
    return atoms(t).where("kind = 'conjecture'").select("id", (sources + F.floor(C("confidence") * 35) + domain).cast("long").alias("score"))


@query("rank_notes", f"WITH {ATOMS}, {FUSED}, m AS (SELECT f.qid, f.id, q.q, a.*, {duck_tokens('substr(a.text, 1, 40)')} AS h, {duck_tokens('a.text')} AS x FROM fused f JOIN q ON q.item_id = f.qid JOIN atoms a ON a.id = f.id WHERE a.collection IN ('canonical', 'semantic')) SELECT qid, id, CAST(16 * len(list_intersect(q, list_distinct(list_concat(h, x)))) + 20 * len(list_intersect(q, h)) + floor(confidence * 20) + CASE WHEN superseded_by IS NULL THEN 10 ELSE 0 END + CASE WHEN floor((epoch({NOW}) - epoch(created_at)) / 86400) <= 30 THEN 6 WHEN floor((epoch({NOW}) - epoch(created_at)) / 86400) > 365 THEN -8 ELSE 0 END AS BIGINT) AS score FROM m")
def rank_notes(t):
    """Shared words, those of the title again, confidence, standing and age."""
    from palimpsest.functions.temporal import age_days

    q = t.benchmark.select(C("item_id").alias("qid"), text.tokens(C("text")).alias("q"))
    a = atoms(t).where("collection IN ('canonical', 'semantic')").select("id", "confidence", "superseded_by", "created_at", text.tokens(F.substring("text", 1, 40)).alias("h"), text.tokens(C("text")).alias("x"))
    m = fused(t).join(q, "qid").join(a, "id")
    shared = lambda s: F.size(F.array_intersect("q", s))
    days = F.floor(age_days(C("created_at"), now_()))
    score = 16 * shared(F.array_union("h", "x")) + 20 * shared(C("h")) + F.floor(C("confidence") * 20) + F.when(C("superseded_by").isNull(), 10).otherwise(0) + F.when(days <= 30, 6).when(days > 365, -8).otherwise(0)
    return m.select("qid", "id", score.cast("long").alias("score"))


@query("rank_category_backfill", f"WITH {ATOMS} SELECT id, CASE WHEN kind <> 'raw_dump' THEN kind WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secret' WHEN contains(lower(text), 'license') THEN 'legal' ELSE 'other' END AS category FROM atoms")
def rank_category_backfill(t):
    has = lambda w: F.lower("text").contains(w)
    return atoms(t).select("id", F.when(C("kind") != "raw_dump", C("kind")).when(has("password") | has("token"), "secret").when(has("license"), "legal").otherwise("other").alias("category"))


@query("rank_self_blend", f"WITH {ATOMS} SELECT id, round(CASE WHEN trust IS NULL THEN confidence ELSE 0.6 * trust + 0.4 * confidence END, 6) AS score FROM atoms")
def rank_self_blend(t):
    """A model's own judgement where there is one, else the heuristic alone."""
    return atoms(t).select("id", F.round(F.when(C("trust").isNull(), C("confidence")).otherwise(0.6 * C("trust") + 0.4 * C("confidence")), 6).alias("score"))


@query("set_collapse", f"WITH {ATOMS}, u AS (SELECT path, topic_key, id, confidence * 100 AS score, collection = 'canonical' AS note FROM atoms) SELECT topic_key, id FROM u QUALIFY row_number() OVER (PARTITION BY topic_key, path ORDER BY note DESC, score DESC, id) = 1")
def set_collapse(t):
    """Of a note and vector hits on one path, the note stays, else the best hit."""
    u = atoms(t).select("path", "topic_key", "id", C("confidence").alias("score"), (C("collection") == "canonical").alias("note"))
    return joins.top_k(u, ["topic_key", "path"], [F.desc("note"), F.desc("score"), C("id")], 1).select("topic_key", "id")


@query("set_duplicate_proposals", f"WITH {ATOMS}, p AS (SELECT id, kind, {duck_tokens('text')} AS x, topic_key FROM atoms WHERE kind IN ('conjecture', 'fact')) SELECT DISTINCT a.id FROM p a JOIN p b ON a.topic_key = b.topic_key AND a.kind = 'conjecture' AND b.id < a.id WHERE {duck_jaccard('a.x', 'b.x')} >= 0.5")
def set_duplicate_proposals(t):
    """Proposals that an earlier proposal or fact on their topic already says."""
    p = atoms(t).where("kind IN ('conjecture', 'fact')").select("id", "kind", "topic_key", text.tokens(C("text")).alias("tokens"))
    return setjoin.alike_within(p, "topic_key", 0.5, ("kind",)).where("kind_b = 'conjecture'").select(C("b").alias("id")).distinct()


@query("topk_blocks", f"WITH {ATOMS} SELECT topic_key, id, row_number() OVER (PARTITION BY topic_key ORDER BY CASE kind WHEN 'decision' THEN 0 WHEN 'preference' THEN 1 WHEN 'fact' THEN 2 ELSE 3 END, confidence DESC, id) AS place FROM atoms WHERE kind <> 'raw_dump' AND confidence >= 0.2")
def topk_blocks(t):
    """Blocks in the order of their kinds; noise and unsure ones are turned away."""
    order = F.when(C("kind") == "decision", 0).when(C("kind") == "preference", 1).when(C("kind") == "fact", 2).otherwise(3)
    rows = atoms(t).where("kind <> 'raw_dump' AND confidence >= 0.2")
    return rows.select("topic_key", "id", F.row_number().over(Window.partitionBy("topic_key").orderBy(order, F.desc("confidence"), "id")).cast("long").alias("place"))


@query("topk_rerank_window", f"WITH {FUSED}, r AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM fused), g AS (SELECT qid, max(score) FILTER (k = 1) - max(score) FILTER (k = 5) AS gap, count(*) AS n FROM r GROUP BY qid) SELECT qid, least(n, CASE WHEN gap > 30 THEN 5 WHEN gap > 10 THEN 10 ELSE 20 END) AS k FROM g")
def topk_rerank_window(t):
    """A clear lead needs few rows reranked; close scores need more."""
    r = fused(t).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    at = lambda k: F.max(F.when(C("k") == k, C("score")))
    g = r.groupBy("qid").agg((at(1) - at(5)).alias("gap"), F.count("*").alias("n"))
    return g.select("qid", F.least(C("n"), F.when(C("gap") > 30, 5).when(C("gap") > 10, 10).otherwise(20)).cast("long").alias("k"))


@query("topk_predictive", f"WITH {AUDIT}, h AS (SELECT atom, hour(ts) AS hour, count(*) AS n FROM audit WHERE atom IS NOT NULL GROUP BY ALL) SELECT hour, atom, n FROM h QUALIFY row_number() OVER (PARTITION BY hour ORDER BY n DESC, atom) <= 5")
def topk_predictive(t):
    """What was used most at this hour of the day."""
    h = audit(t).where("atom IS NOT NULL").groupBy("atom", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return joins.top_k(h, ["hour"], [F.desc("n"), C("atom")], 5).select("hour", "atom", "n")


@query("topk_compaction", f"WITH {ATOMS} SELECT topic_key, count(*) AS n, round(avg(confidence), 6) AS confidence, count(*) FILTER (superseded_by IS NOT NULL) AS stale FROM atoms GROUP BY topic_key HAVING count(*) >= 3 ORDER BY n DESC, topic_key LIMIT 10")
def topk_compaction(t):
    """The ten clusters that compaction would gain most by."""
    g = atoms(t).groupBy("topic_key").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count("superseded_by").alias("stale"))
    return g.where("n >= 3").orderBy(F.desc("n"), "topic_key").limit(10)
