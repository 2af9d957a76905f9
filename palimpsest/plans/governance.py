"""Queries on what comes after retrieval: diversity, boosts, rules, authority; and on questions and notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import fusion, governance, joins, pairs, setjoin
from palimpsest.plans.bindings import ATOMS, NOW, atoms, duck_decay, duck_jaccard, duck_tokens, now_
from palimpsest.plans.joins import COS
from palimpsest.plans.registry import query
from palimpsest.plans.windows import LISTS, ranked_lists

C = F.col
FUSED = f"{LISTS}, fused AS (SELECT qid, id, round(100 * s / den, 6) AS score FROM f JOIN den USING (qid))"


def fused(t):
    """qid, id, score of every question's candidates."""
    return fusion.rrf(ranked_lists(t), {"jaccard": 0.9, "cover": 1.0}).select("qid", "id", F.round("score", 6).alias("score"))


def ranked(t):
    """fused with source and rank from 1."""
    rows = fused(t).join(t.documents.select(C("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source")), "id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))


RANKED = f"{FUSED}, ranked AS (SELECT qid, id, score, coalesce(source, '') AS source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused JOIN documents ON doc_id = id)"
PLACED = f"{RANKED}, ov AS (SELECT *, source <> '' AND row_number() OVER (PARTITION BY qid, source ORDER BY rank) > 2 AS o FROM ranked), lt AS (SELECT *, o AND coalesce(sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS late FROM ov), placed AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY late, rank) AS place FROM lt)"


@query("win_diversify", f"WITH {PLACED} SELECT qid, id, place FROM placed")
def win_diversify(t):
    return governance.diversified(ranked(t)).select("qid", "id", C("place").cast("long").alias("place"))


@query("topk_sort_diversify", f"WITH {PLACED} SELECT qid, id, place FROM placed WHERE place <= 5")
def topk_sort_diversify(t):
    return governance.diversified(ranked(t)).where("place <= 5").select("qid", "id", C("place").cast("long").alias("place"))


@query("set_fusion_key", f"WITH {ATOMS} SELECT CASE WHEN collection IN ('semantic', 'experience', 'patterns') THEN CAST(id AS VARCHAR) ELSE coalesce(path, CAST(id AS VARCHAR)) END AS key, count(*) AS n FROM atoms GROUP BY 1")
def set_fusion_key(t):
    return atoms(t).groupBy(governance.fusion_key(C("collection"), C("id"), C("path"), F.lit(None).cast("string")).alias("key")).agg(F.count("*").alias("n"))


@query("set_variants", f"WITH {FUSED}, sh AS (SELECT a.qid, b.id, b.score, row_number() OVER (PARTITION BY a.qid ORDER BY b.score DESC, b.id) - 1 AS rank FROM (SELECT item_id AS qid, item_id + 1 AS variant FROM benchmark) a JOIN fused b ON b.qid = a.variant), o AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM fused), u AS (SELECT qid, id, 1.0 / (60 + rank) AS w, 'asked' AS l FROM o UNION ALL SELECT qid, id, 1.0 / (60 + rank), 'variant' FROM sh), n AS (SELECT qid, count(DISTINCT l) / 60.0 AS most FROM u GROUP BY qid) SELECT u.qid, id, round(100 * sum(w) / max(most), 4) AS score FROM u JOIN n ON u.qid = n.qid GROUP BY u.qid, id")
def set_variants(t):
    """A question's list and that of its rewriting (the next question stands for it), fused."""
    own = fused(t)
    variant = t.benchmark.select(C("item_id").alias("asked"), (C("item_id") + 1).alias("qid")).join(own, "qid").select(C("asked").alias("qid"), "id", "score")
    lists = own.withColumn("source", F.lit("asked")).unionByName(variant.withColumn("source", F.lit("variant")))
    rank = F.row_number().over(Window.partitionBy("qid", "source").orderBy(F.desc("score"), "id")) - 1
    return fusion.rrf(lists.withColumn("rank", rank), {}).select("qid", "id", F.round("score", 4).alias("score"))


@query("rank_metadata_boost", f"WITH {FUSED}, {ATOMS}, m AS (SELECT f.qid, f.id, q.q, a.collection, a.kind, {duck_tokens("concat_ws(' ', a.path, a.topic_key, a.kind, a.tier)")} AS mt, lower(b.text) AS asked FROM fused f JOIN q ON q.item_id = f.qid JOIN benchmark b ON b.item_id = f.qid JOIN atoms a ON a.id = f.id), o AS (SELECT *, CASE WHEN len(q) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, mt)) AS DOUBLE) / len(q) END AS ov, contains(asked, 'th') AS infra, contains(asked, 'en') AS code, contains(asked, 'le') AS canon FROM m) SELECT qid, id, round(CASE WHEN ov > 0 THEN least(1.35, 1 + 0.45 * ov) ELSE 1.0 END * CASE WHEN infra AND collection = 'knowledge' THEN CASE WHEN kind = 'fact' THEN 1.45 ELSE 1.15 END ELSE 1.0 END * CASE WHEN infra AND collection = 'experience' THEN 0.88 ELSE 1.0 END * CASE WHEN canon AND collection IN ('canonical', 'distilled') THEN 1.35 ELSE 1.0 END, 6) AS boost FROM o")
def rank_metadata_boost(t):
    q = t.benchmark.select(C("item_id").alias("qid"), text.tokens(C("text")).alias("q"), F.lower("text").alias("asked"))
    a = atoms(t).select("id", "collection", "kind", text.tokens(F.concat_ws(" ", "path", "topic_key", "kind", "tier")).alias("mt"))
    m = fused(t).join(q, "qid").join(a, "id")
    asks = lambda part: C("asked").contains(part)
    boost = governance.metadata_boost(text.coverage(C("q"), C("mt")), asks("th"), asks("en"), asks("le"), C("collection"), C("kind") == "fact")
    return m.select("qid", "id", F.round(boost, 6).alias("boost"))


@query("rank_source_boost", "WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]+')), lambda x: len(x) >= 3) AS terms, concat('/srv/', role, '/', 'quelle', conv_id % 7, '.md') AS source, CASE conv_id % 3 WHEN 0 THEN 'und' WHEN 1 THEN 'the' ELSE 'les' END AS service FROM conversations) SELECT conv_id, turn, CAST(CASE WHEN len(list_filter(terms, lambda x: contains(source, '/' || x || '/') OR contains(source, '/' || x || '.') OR x = service)) > 0 THEN 0.45 WHEN len(list_filter(terms, lambda x: contains(source, x))) > 0 THEN 0.15 ELSE 0.0 END AS DOUBLE) AS boost FROM w")
def rank_source_boost(t):
    terms = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9_-]+)"), F.lit(1))), lambda x: F.length(x) >= 3)
    w = t.conversations.select("conv_id", "turn", terms.alias("terms"), F.concat(F.lit("/srv/"), "role", F.lit("/quelle"), (C("conv_id") % 7).cast("string"), F.lit(".md")).alias("source"), F.when(C("conv_id") % 3 == 0, "und").when(C("conv_id") % 3 == 1, "the").otherwise("les").alias("service"))
    return w.select("conv_id", "turn", governance.source_boost(C("terms"), C("source"), C("service")).cast("double").alias("boost"))


@query("rank_decay_once", f"WITH {ATOMS} SELECT id, CASE WHEN provisional THEN round(confidence * 100, 2) ELSE round(round(confidence * 100, 2) * {duck_decay('created_at', 'collection', 'valid_until')}, 2) END AS score, TRUE AS decayed FROM atoms")
def rank_decay_once(t):
    """Rows that are marked have their decay already; a second run changes nothing."""
    from palimpsest.functions import temporal

    factor = temporal.decay(C("created_at"), C("collection"), C("valid_until"), now_())
    once = lambda df: df.withColumn("score", F.when(C("decayed"), C("score")).otherwise(F.round(C("score") * factor, 2))).withColumn("decayed", F.lit(True))
    rows = atoms(t).withColumn("score", F.round(C("confidence") * 100, 2)).withColumn("decayed", C("provisional"))
    return once(once(rows)).select("id", "score", "decayed")


@query("rank_temporal_demotion", f"WITH {ATOMS}, n AS (SELECT id, topic_key, confidence * 100 AS score, created_at, {duck_tokens('text')} AS x, {duck_tokens('text', False)} AS every FROM atoms QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY created_at DESC, id) <= 12), p AS (SELECT DISTINCT o.id FROM n o JOIN n w ON o.topic_key = w.topic_key AND o.created_at < w.created_at WHERE {duck_jaccard('o.x', 'w.x')} >= 0.05 AND list_has_any(o.every, {list(text.NEGATIVE)}) <> list_has_any(w.every, {list(text.NEGATIVE)})) SELECT n.id, round(CASE WHEN p.id IS NULL THEN score ELSE score - 160 END, 6) AS score, p.id IS NOT NULL AS stale FROM n LEFT JOIN p ON n.id = p.id")
def rank_temporal_demotion(t):
    """Of two statements on one topic that share words and differ in negation, the older falls, once."""
    negative = F.arrays_overlap(text.tokens(C("text"), stop=()), F.array(*map(F.lit, text.NEGATIVE)))
    n = joins.top_k(atoms(t).select("id", "topic_key", (C("confidence") * 100).alias("score"), "created_at", "text"), ["topic_key"], [F.desc("created_at"), C("id")], 12).select("id", "topic_key", "score", "created_at", text.tokens(C("text")).alias("x"), negative.alias("negative"))
    w = n.select(C("topic_key"), C("created_at").alias("later"), C("x").alias("y"), C("negative").alias("other"))
    stale = n.join(w, "topic_key").where("created_at < later AND negative <> other").where(text.jaccard(C("x"), C("y")) >= 0.05).select("id").distinct().withColumn("stale", F.lit(True))
    rows = n.join(stale, "id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    return rows.select("id", F.round(F.when(C("stale"), C("score") - governance.STALE_PENALTY).otherwise(C("score")), 6).alias("score"), "stale")


@query("rank_primary_document", f"WITH {FUSED}, {ATOMS} SELECT qid, f.id, round(CASE WHEN kind = 'decision' THEN score + 35 ELSE score END, 4) AS score FROM fused f JOIN atoms a ON a.id = f.id")
def rank_primary_document(t):
    rows = fused(t).join(atoms(t).select("id", "kind"), "id")
    return rows.select("qid", "id", F.round(F.when(C("kind") == "decision", C("score") + governance.PRIMARY_BOOST).otherwise(C("score")), 4).alias("score"))


#: A table of rules over a row, readable by both engines; users give their own.
RULES = (
    governance.Rule("durable_memory", "collection = 'semantic' AND superseded_by IS NULL", 12.0),
    governance.Rule("vanished_source", "path IS NULL", -40.0),
    governance.Rule("obsolete_row", "tier = 'obsolete'", -80.0),
    governance.Rule("raw_dump", "kind = 'raw_dump'", -30.0),
    governance.Rule("provisional", "provisional", -8.0),
    governance.Rule("owner_said", "speaker = 'owner' AND confidence >= 0.5", 6.0),
    governance.Rule("session_scope", "scope = 'session'", -4.0),
)


@query("rank_governance", f"WITH {ATOMS} SELECT id, round(confidence * 100 " + " ".join(f"+ CASE WHEN {r.when} THEN {r.delta} ELSE 0 END" for r in RULES) + ", 6) AS score, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r.when} THEN '{r.reason}' END" for r in RULES) + "], lambda x: x IS NOT NULL), ',') AS reasons FROM atoms")
def rank_governance(t):
    rows = governance.governed(atoms(t).withColumn("score", C("confidence") * 100), RULES)
    return rows.select("id", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


SIGNATURE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', ' ', 'g'), '[0-9]+', ' ', 'g'), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("set_quality_filter", f"WITH {ATOMS}, g AS (SELECT id, confidence, CASE WHEN {SIGNATURE} = '' THEN CAST(id AS VARCHAR) ELSE {SIGNATURE} END AS key FROM atoms WHERE kind <> 'raw_dump' AND tier <> 'obsolete') SELECT id FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY confidence DESC, id) = 1")
def set_quality_filter(t):
    """Classes that are noise go; of rows with one signature the best stays. set_greedy_dedup then drops near ones."""
    rows = atoms(t).where("kind <> 'raw_dump' AND tier <> 'obsolete'")
    key = text.signature(C("text"))
    keyed = rows.select("id", "confidence", F.md5(F.when(key == "", C("id").cast("string")).otherwise(key)).alias("key"))
    return joins.top_k(keyed, ["key"], [F.desc("confidence"), C("id")], 1).select("id")


@query("fn_authority_tier", f"WITH {ATOMS} SELECT id, CASE WHEN tier = 'obsolete' OR superseded_by IS NOT NULL THEN 'obsolete' WHEN kind <> 'raw_dump' AND (collection = 'semantic' OR kind IN ('preference', 'decision', 'fact')) THEN 'direct' WHEN collection = 'knowledge' THEN 'quote' WHEN kind = 'event' THEN 'episodic' WHEN kind = 'raw_dump' THEN 'derived' ELSE 'curated' END AS authority FROM atoms")
def fn_authority_tier(t):
    derived = C("kind") == "raw_dump"
    durable = ~derived & ((C("collection") == "semantic") | C("kind").isin("preference", "decision", "fact"))
    return atoms(t).select("id", governance.authority_tier((C("tier") == "obsolete") | C("superseded_by").isNotNull(), durable, C("collection") == "knowledge", C("kind") == "event", derived).alias("authority"))


@query("flt_normalise_note", f"WITH {FUSED}, m AS (SELECT f.qid, f.id, f.score, q.q, {duck_tokens('substr(d.text, 1, 40)')} AS h, {duck_tokens('substr(d.text, 1, 400)')} AS b FROM fused f JOIN q ON q.item_id = f.qid JOIN documents d ON d.doc_id = f.id), o AS (SELECT *, CASE WHEN len(q) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, h)) AS DOUBLE) / len(q) END AS ot, CASE WHEN len(q) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, list_distinct(list_concat(h, b)))) AS DOUBLE) / len(q) END AS ob FROM m) SELECT qid, id, round(least(score * 3, 200.0) / 200 * 100 * CASE WHEN len(q) > 0 AND ot = 0 AND ob < 0.5 THEN 0.2 WHEN len(q) > 0 AND ob < 0.3 THEN 0.5 ELSE 1.0 END * 0.95, 2) AS score FROM o")
def flt_normalise_note(t):
    """Title of 40 characters and summary of 400, as the operator reads them."""
    q = t.benchmark.select(C("item_id").alias("qid"), text.tokens(C("text")).alias("q"))
    d = t.documents.select(C("doc_id").alias("id"), text.tokens(F.substring("text", 1, 40)).alias("h"), text.tokens(F.substring("text", 1, 400)).alias("b"))
    m = fused(t).join(q, "qid").join(d, "id")
    return m.select("qid", "id", governance.note_score(C("score") * 3, text.coverage(C("q"), C("h")), text.coverage(C("q"), F.array_union("h", "b")), F.lit(0.95), F.size("q") > 0).alias("score"))


@query("flt_normalise_vault", f"WITH {ATOMS} SELECT id, round(confidence * 100 * 0.8, 2) AS score, length(substr(text, 1, 800)) AS shown FROM atoms WHERE collection = 'obsidian'")
def flt_normalise_vault(t):
    """Content of 800 characters, as the operator shows it."""
    return atoms(t).where("collection = 'obsidian'").select("id", F.round(C("confidence") * 100 * 0.8, 2).alias("score"), F.length(F.substring("text", 1, 800)).cast("long").alias("shown"))


@query("flt_superseded_note", f"WITH {ATOMS} SELECT id FROM atoms WHERE tier = 'obsolete' OR superseded_by IS NOT NULL OR contains(lower(substr(text, 1, 1600)), '\"status\": \"superseded\"')")
def flt_superseded_note(t):
    head = F.lower(F.substring("text", 1, 1600))
    return atoms(t).where((C("tier") == "obsolete") | C("superseded_by").isNotNull() | head.contains('"status": "superseded"')).select("id")


@query("flt_stale_truth", f"WITH {ATOMS}, gone AS (SELECT DISTINCT topic_key FROM atoms WHERE superseded_by IS NOT NULL AND kind = 'fact') SELECT id FROM atoms JOIN gone USING (topic_key) WHERE kind = 'fact' AND superseded_by IS NULL AND created_at < {NOW} - INTERVAL 180 DAY")
def flt_stale_truth(t):
    """Current-state claims on a topic where one is known to be superseded, if they are old themselves."""
    a = atoms(t).where("kind = 'fact'")
    gone = a.where("superseded_by IS NOT NULL").select("topic_key").distinct()
    return a.where("superseded_by IS NULL").where(C("created_at") < now_() - F.expr("INTERVAL 180 DAY")).join(gone, "topic_key", "left_semi").select("id")


@query("flt_nonempty_lists", f"WITH {LISTS} SELECT qid, source, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 0")
def flt_nonempty_lists(t):
    return ranked_lists(t).groupBy("qid", "source").agg(F.count("*").alias("n")).where("n > 0")


# -- questions

DEFAULT_SOURCES = ("canonical", "rag", "graph", "obsidian")
TEMPORAL, PREFERENCE = r"\b(when|yesterday|last week|today|since)\b", r"\b(prefer|like|favou?rite|want)\b"
CODE = r"\b(how does|how to|function|class|method|api|endpoint|module|import|syntax|error|debug)\b"
BROAD = ("compare", "pattern", "overall", "summary", "versus")
DUCK_SOURCES = "['canonical', 'rag', 'graph', 'obsidian']"


@query("qry_route_sources", f"SELECT conv_id, turn, array_to_string(CASE WHEN regexp_matches(lower(text), '{TEMPORAL}') THEN list_filter({DUCK_SOURCES}, lambda s: s <> 'graph') WHEN regexp_matches(lower(text), '{PREFERENCE}') THEN list_filter({DUCK_SOURCES}, lambda s: s <> 'obsidian') WHEN regexp_matches(lower(text), '{CODE}') THEN list_filter({DUCK_SOURCES}, lambda s: s NOT IN ('canonical', 'obsidian')) ELSE {DUCK_SOURCES} END, ',') AS sources FROM conversations")
def qry_route_sources(t):
    every, asked = F.array(*map(F.lit, DEFAULT_SOURCES)), F.lower("text")
    but = lambda *names: F.array_except(every, F.array(*map(F.lit, names)))
    routed = F.when(asked.rlike(TEMPORAL), but("graph")).when(asked.rlike(PREFERENCE), but("obsidian")).when(asked.rlike(CODE), but("canonical", "obsidian")).otherwise(every)
    return t.conversations.select("conv_id", "turn", F.array_join(routed, ",").alias("sources"))


@query("qry_broad", "SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) > 4 OR " + " OR ".join(f"contains(lower(text), '{w}')" for w in BROAD) + " AS broad FROM conversations")
def qry_broad(t):
    words = F.regexp_count("text", F.lit(r"\S+")) > 4
    for w in BROAD:
        words = words | F.lower("text").contains(w)
    return t.conversations.select("conv_id", "turn", words.alias("broad"))


@query("qry_entity", "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(related|connected|between|with whom)\\b') OR len(regexp_extract_all(text, '\\b[A-Z][a-z]+')) >= 2 AS entity FROM conversations")
def qry_entity(t):
    related = F.lower("text").rlike(r"\b(related|connected|between|with whom)\b")
    return t.conversations.select("conv_id", "turn", (related | (F.regexp_count("text", F.lit(r"\b[A-Z][a-z]+")) >= 2)).alias("entity"))


FANOUT = ((r"\b(role|owner|who is)\b", 50), (r"\b(port|config|server)\b", 40), (r"\b(canonical|decision)\b", 30), (PREFERENCE, 25))


@query("qry_fanout", "SELECT conv_id, turn, CAST(greatest(20, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN {n}" for p, n in FANOUT) + " ELSE 0 END) AS INT) AS fanout FROM conversations")
def qry_fanout(t):
    wide = F.lit(0)
    for pattern, n in reversed(FANOUT):
        wide = F.when(F.lower("text").rlike(pattern), n).otherwise(wide)
    return t.conversations.select("conv_id", "turn", F.greatest(F.lit(20), wide).cast("int").alias("fanout"))


@query("qry_corrective", f"WITH q AS (SELECT conv_id, turn, role = 'user' AS explicit, len({duck_tokens('text')}) AS n, regexp_matches(lower(text), '\\b(and|or|versus|vs|compare|both)\\b') AS several FROM conversations) SELECT conv_id, turn, CASE WHEN several AND n > 6 THEN TRUE WHEN n > 4 OR several THEN explicit ELSE FALSE END AS corrective FROM q")
def qry_corrective(t):
    """A question of several parts is always asked again; a simple one never; others if the caller says so."""
    from palimpsest.operators import retrieval

    kind = retrieval.complexity(C("text"))
    return t.conversations.select("conv_id", "turn", F.when(kind == "multi", True).when(kind == "single", C("role") == "user").otherwise(False).alias("corrective"))


@query("qry_rewrites", "WITH p AS (SELECT n_nationkey AS id, concat(n_name, ' 설정 ', CASE WHEN n_nationkey % 2 = 0 THEN 'port 8080' ELSE '' END) AS q FROM nation), c AS (SELECT id, q, array_to_string(regexp_extract_all(q, '[a-zA-Z][a-zA-Z0-9_.-]+'), ' ') AS latin, array_to_string(regexp_extract_all(q, '[가-힣]+'), ' ') AS hangul FROM p) SELECT id, CASE WHEN latin <> '' AND hangul <> '' THEN concat_ws('|', hangul, latin) ELSE '' END AS rewrites FROM c")
def qry_rewrites(t):
    q = F.concat("n_name", F.lit(" 설정 "), F.when(C("n_nationkey") % 2 == 0, "port 8080").otherwise(""))
    script = lambda p: F.array_join(F.regexp_extract_all(q, F.lit(f"({p})"), F.lit(1)), " ")
    latin, hangul = script("[a-zA-Z][a-zA-Z0-9_.-]+"), script("[가-힣]+")
    return t.nation.select(C("n_nationkey").alias("id"), F.when((latin != "") & (hangul != ""), F.concat_ws("|", hangul, latin)).otherwise("").alias("rewrites"))


@query("qry_route_guarantees", "WITH r AS (SELECT * FROM (VALUES ('money', 'price'), ('money', 'cost'), ('people', 'und'), ('people', 'the')) AS r(route, word)), w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+')) AS word FROM conversations) SELECT DISTINCT conv_id, turn, route FROM w JOIN r USING (word)")
def qry_route_guarantees(t):
    rules = t.spark.createDataFrame([("money", "price"), ("money", "cost"), ("people", "und"), ("people", "the")], "route string, word string")
    words = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+|[가-힣]+)"), F.lit(1)))).alias("word"))
    return words.join(rules, "word").select("conv_id", "turn", "route").distinct()


@query("qry_prompt_class", f"SELECT conv_id, turn, CASE WHEN length(text) < 12 THEN 'skip' WHEN regexp_matches(lower(text), '{CODE}') THEN 'code' WHEN regexp_matches(lower(text), '{PREFERENCE}') THEN 'personal' WHEN contains(text, '?') THEN 'question' ELSE 'task' END AS kind FROM conversations")
def qry_prompt_class(t):
    asked = F.lower("text")
    return t.conversations.select("conv_id", "turn", F.when(F.length("text") < 12, "skip").when(asked.rlike(CODE), "code").when(asked.rlike(PREFERENCE), "personal").when(C("text").contains("?"), "question").otherwise("task").alias("kind"))


@query("qry_live_state", "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(now|currently|running|status|up)\\b') AND NOT regexp_matches(lower(text), '\\b(was|were|history|last year)\\b') AS live FROM conversations")
def qry_live_state(t):
    asked = F.lower("text")
    return t.conversations.select("conv_id", "turn", (asked.rlike(r"\b(now|currently|running|status|up)\b") & ~asked.rlike(r"\b(was|were|history|last year)\b")).alias("live"))


# -- words

SCRIPT = "[a-z0-9]+|[가-힣]+"


@query("fn_script_tokens", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '{SCRIPT}'), lambda x: len(x) > 1))), ' ') AS words FROM documents")
def fn_script_tokens(t):
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(f"({SCRIPT})"), F.lit(1)), lambda x: F.length(x) > 1)
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("words"))


@query("fn_content_tokens", f"SELECT doc_id, len(list_filter(list_distinct(list_filter(regexp_extract_all(lower(text), '{SCRIPT}'), lambda x: len(x) > 1)), lambda x: NOT list_contains({list(text.STOPWORDS)}, x))) AS n FROM documents")
def fn_content_tokens(t):
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(f"({SCRIPT})"), F.lit(1)), lambda x: F.length(x) > 1)
    return t.documents.select("doc_id", F.size(F.array_except(found, F.array(*map(F.lit, text.STOPWORDS)))).cast("long").alias("n"))


@query("fn_separators", "SELECT page_id, regexp_replace(url, '[/_]+', ' ', 'g') AS words FROM pages")
def fn_separators(t):
    return t.pages.select("page_id", F.regexp_replace("url", "[/_]+", " ").alias("words"))


_P = str(governance.PARTICLES)


@query("fn_particle", f"WITH w AS (SELECT n_nationkey AS id, concat(['파일', '회', '서버', 'port', '크리스'][1 + n_nationkey % 5], {_P}[1 + n_nationkey % {len(governance.PARTICLES)}]) AS w FROM nation), p AS (SELECT id, w, list_filter({_P}, lambda p: ends_with(w, p) AND len(w) > len(p))[1] AS p FROM w) SELECT id, CASE WHEN regexp_matches(w, '^[가-힣]') AND p IS NOT NULL AND len(w) - len(p) >= 2 THEN left(w, len(w) - len(p)) ELSE w END AS stem FROM p")
def fn_particle(t):
    heads = F.array(*map(F.lit, ("파일", "회", "서버", "port", "크리스")))
    tails = F.array(*map(F.lit, governance.PARTICLES))
    w = t.nation.select(C("n_nationkey").alias("id"), F.concat(F.element_at(heads, (1 + C("n_nationkey") % 5).cast("int")), F.element_at(tails, (1 + C("n_nationkey") % len(governance.PARTICLES)).cast("int"))).alias("w"))
    return w.select("id", governance.stem(C("w")).alias("stem"))


@query("fn_unnegated", "WITH g AS (SELECT conv_id, turn, string_split_regex(replace(replace(lower(text), '''', ''), '’', ''), '\\bund\\b') AS gaps FROM conversations) SELECT conv_id, turn, len(list_filter(gaps[1:len(gaps) - 1], lambda gap: NOT list_has_any(list_reverse(regexp_extract_all(gap, '[a-z0-9]+|[가-힣]+'))[1:3], " + str(governance.CUES) + "))) > 0 AS met FROM g")
def fn_unnegated(t):
    return t.conversations.select("conv_id", "turn", governance.has_unnegated(C("text"), r"\bund\b").alias("met"))


@query("fn_like_escape", "SELECT page_id, replace(replace(replace(url, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM pages")
def fn_like_escape(t):
    escaped = C("url")
    for sign in ("\\", "%", "_"):
        escaped = F.replace(escaped, F.lit(sign), F.lit("\\" + sign))
    return t.pages.select("page_id", escaped.alias("escaped"))


@query("fn_fts_query", "SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_가-힣]+')[1:12], lambda w: concat('\"', w, '\"')), ' ') AS q FROM conversations")
def fn_fts_query(t):
    words = F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_가-힣]+)"), F.lit(1)), 1, 12)
    return t.conversations.select("conv_id", "turn", F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ").alias("q"))


@query("fn_sparse_words", f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+'), lambda x: NOT list_contains({list(text.STOPWORDS)}, x))) AS n FROM documents")
def fn_sparse_words(t):
    """Words of the text without the marks of its letters; the table maps the letters that the given texts have."""
    plain = F.translate(F.lower("text"), "áàâäçéèêëíìîïñóòôöúùûü", "aaaaceeeeiiiinoooouuuu")
    words = F.filter(F.regexp_extract_all(plain, F.lit("([a-z0-9_]+)"), F.lit(1)), lambda x: ~x.isin(*text.STOPWORDS))
    return t.documents.select("doc_id", F.size(words).cast("long").alias("n"))


@query("fn_sparse_tokens", f"SELECT doc_id, list_filter(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}_]+'), lambda x: NOT list_contains({list(text.STOPWORDS)}, x)) AS words FROM documents")
def fn_sparse_tokens(t):
    return t.documents.select("doc_id", text.sparse_tokens(C("text")).alias("words"))


# -- joins on hits


@query("join_weight_map", f"WITH {ATOMS}, w AS (SELECT concat('atom:', id) AS raw, round(1 - 0.15 * (id % 4), 2) AS weight FROM atoms WHERE id % 2 = 0), v AS (SELECT raw AS key, weight FROM w UNION SELECT split_part(raw, ':', 2), weight FROM w), h AS (SELECT id, CASE WHEN id % 3 = 0 THEN concat('atom:', id) ELSE CAST(id AS VARCHAR) END AS key FROM atoms) SELECT h.id, CAST(coalesce(weight, 1.0) AS DOUBLE) AS weight FROM h LEFT JOIN v USING (key)")
def join_weight_map(t):
    """Weights are found under every spelling of an id: as given, and without its prefix."""
    a = atoms(t).select("id")
    w = a.where("id % 2 = 0").select(F.concat(F.lit("atom:"), C("id").cast("string")).alias("raw"), F.round(1 - 0.15 * (C("id") % 4), 2).alias("weight"))
    v = w.select(F.explode(F.array_distinct(F.array("raw", F.substring_index("raw", ":", -1)))).alias("key"), "weight")
    h = a.select("id", F.when(C("id") % 3 == 0, F.concat(F.lit("atom:"), C("id").cast("string"))).otherwise(C("id").cast("string")).alias("key"))
    return h.join(v, "key", "left").select("id", F.coalesce("weight", F.lit(1.0)).alias("weight"))


@query("join_triple_link", f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS triple, round({COS}, 4) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), p AS (SELECT qid, triple FROM s WHERE c >= 0.2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, triple) <= 5), e AS (SELECT qid, unnest(['s' || CAST(triple % 50 AS VARCHAR), 'o' || CAST(triple % 70 AS VARCHAR)]) AS entity FROM p) SELECT DISTINCT qid, entity FROM e")
def join_triple_link(t):
    """A question's triples by likeness (the threshold is a parameter; these vectors are far apart), five at most, and the
    entities at both ends of them."""
    own = pairs.asked(t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", "label"), pairs.points(t.embeddings, "vec_id", "embedding", "label")
    top = pairs.nearest(*own, 5, by=("label",), least=0.2).select("qid", C("id").alias("triple"))
    ends = F.array(F.concat(F.lit("s"), (C("triple") % 50).cast("string")), F.concat(F.lit("o"), (C("triple") % 70).cast("string")))
    return top.select("qid", F.explode(ends).alias("entity")).distinct()


@query("join_contradiction_candidates", f"WITH {ATOMS}, s AS (SELECT a.vec_id AS new_id, b.vec_id AS old_id, round(1 - {COS}, 4) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY d, old_id) AS k FROM s) SELECT new_id, old_id, n.confidence >= o.confidence + 0.2 AS auto_resolved FROM r JOIN atoms n ON n.id = new_id JOIN atoms o ON o.id = old_id WHERE k <= 8 AND n.kind = o.kind")
def join_contradiction_candidates(t):
    """The eight nearest older memories of one label; a new one that is clearly surer settles it by itself."""
    own = pairs.asked(t.embeddings, "vec_id", "embedding", "label"), pairs.points(t.embeddings, "vec_id", "embedding", "label")
    near = pairs.nearest(*own, 8, pairs.OLDER, ("label",), apart=True).select(C("qid").alias("new_id"), C("id").alias("old_id"))
    a = atoms(t).select("id", "kind", "confidence")
    both = near.join(a.toDF("new_id", "kind", "confidence"), "new_id").join(a.toDF("old_id", "old_kind", "old_confidence"), "old_id").where("kind = old_kind")
    return both.select("new_id", "old_id", (C("confidence") >= C("old_confidence") + 0.2).alias("auto_resolved"))


@query("join_near_duplicates", f"WITH d AS (SELECT doc_id, source, length(text) AS l, {duck_tokens('text')} AS x FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.l AS la, b.l AS lb FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id WHERE least(a.l, b.l) >= 0.3 * greatest(a.l, b.l) AND {duck_jaccard('a.x', 'b.x')} >= 0.5) SELECT a, b, CASE WHEN la > lb THEN a ELSE b END AS kept FROM p")
def join_near_duplicates(t):
    """Pairs of a source that share half of their words, found through the words; the longer stays, of equals the newer."""
    d = t.documents.select(C("doc_id").alias("id"), "source", F.length("text").alias("l"), text.tokens(C("text")).alias("tokens"))
    p = setjoin.alike_within(d, "source", 0.5, ("l",)).where("least(l_a, l_b) >= 0.3 * greatest(l_a, l_b)")
    return p.select("a", "b", F.when(C("l_a") > C("l_b"), C("a")).otherwise(C("b")).alias("kept"))


@query("join_corroborating", f"WITH {ATOMS} SELECT r.id AS rejected, count(*) AS n FROM atoms r JOIN atoms s ON r.topic_key = s.topic_key AND s.created_at > r.created_at AND s.id <> r.id WHERE r.tier = 'obsolete' AND s.confidence >= 0.6 GROUP BY r.id")
def join_corroborating(t):
    """Records on a rejected one's topic that came after it."""
    a = atoms(t)
    r = a.where("tier = 'obsolete'").select(C("id").alias("rejected"), "topic_key", C("created_at").alias("at"))
    return r.join(a.where("confidence >= 0.6").select("id", "topic_key", "created_at"), "topic_key").where("created_at > at AND id <> rejected").groupBy("rejected").agg(F.count("*").alias("n"))


@query("join_valence", f"WITH {ATOMS}, v AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS atom, round(avg(CASE event_type WHEN 'error' THEN -1.0 WHEN 'purchase' THEN 1.0 ELSE 0.0 END), 4) AS valence FROM events GROUP BY 1) SELECT id, coalesce(valence, 0.0) AS valence FROM atoms LEFT JOIN v ON atom = id")
def join_valence(t):
    v = t.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("id")).agg(F.round(F.avg(F.when(C("event_type") == "error", -1.0).when(C("event_type") == "purchase", 1.0).otherwise(0.0)), 4).alias("valence"))
    return atoms(t).select("id").join(v, "id", "left").select("id", F.coalesce("valence", F.lit(0.0)).alias("valence"))
