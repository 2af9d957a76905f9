"""Queries on scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import temporal, text, vector
from palimpsest.operators import filters
from palimpsest.plans.bindings import ATOMS, AUDIT, FACTS, NOW, atoms, audit, duck_jaccard, duck_tokens, facts, now_
from palimpsest.plans.registry import query

D = duck_tokens


@query("fn_tokenize", f"SELECT doc_id, CAST(len({D('text')}) AS BIGINT) AS n, array_to_string(list_sort({D('text')})[1:5], ' ') AS first FROM documents")
def fn_tokenize(t):
    x = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n"), F.array_join(F.slice(F.array_sort(x), 1, 5), " ").alias("first"))


@query("fn_sparse_tf", f"SELECT tok AS token, CAST(('0x' || md5(tok)[1:8]) AS BIGINT) AS idx, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_\\-]{{2,}}|[가-힣]{{2,}}')) AS tok FROM benchmark) GROUP BY tok")
def fn_sparse_tf(t):
    found = t.benchmark.select(F.explode(text.token_list(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("tf")).withColumn("idx", text.token_index(F.col("token")))


@query("fn_jaccard", f"WITH q AS (SELECT item_id, {D('text')} AS q FROM benchmark), d AS (SELECT doc_id, {D('text')} AS d FROM documents) SELECT item_id, doc_id, round({duck_jaccard('q', 'd')}, 6) AS j, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, d)) AS DOUBLE) / len(q) END, 6) AS cover, round(CASE WHEN least(len(q), len(d)) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q, d)) AS DOUBLE) / least(len(q), len(d)) END, 6) AS inside FROM q JOIN d ON item_id = doc_id % 40")
def fn_jaccard(t):
    q = t.benchmark.select("item_id", text.tokens(F.col("text")).alias("q"))
    d = t.documents.select("doc_id", text.tokens(F.col("text")).alias("d"))
    both = q.join(d, F.col("item_id") == F.col("doc_id") % 40)
    return both.select("item_id", "doc_id", F.round(text.jaccard(F.col("q"), F.col("d")), 6).alias("j"), F.round(text.coverage(F.col("q"), F.col("d")), 6).alias("cover"), F.round(text.containment(F.col("q"), F.col("d")), 6).alias("inside"))


@query("fn_cosine", "WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS cos FROM embeddings, q")
def fn_cosine(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q)).select("vec_id", F.round(vector.cosine(F.col("q"), F.col("embedding")), 6).alias("cos"))


@query("fn_matryoshka", "WITH s AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x1, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS x16 FROM s")
def fn_matryoshka(t):
    x = t.embeddings.select("vec_id", vector.truncated(F.col("embedding"), 16).alias("v"))
    return x.select("vec_id", F.round(F.col("v")[0], 6).alias("x1"), F.round(F.col("v")[15], 6).alias("x16"))


@query("fn_logit", f"WITH {ATOMS}, c AS (SELECT id, least(0.98, greatest(0.02, confidence)) AS p FROM atoms) SELECT id, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.4))), 6) AS raised FROM c")
def fn_logit(t):
    p = F.least(F.lit(0.98), F.greatest(F.lit(0.02), F.col("confidence")))
    logit = F.ln(p / (1 - p))
    return atoms(t).select("id", F.round(logit, 6).alias("logit"), F.round(1 / (1 + F.exp(-(logit + 0.4))), 6).alias("raised"))


@query("fn_age_days", f"WITH {ATOMS} SELECT id, round((epoch({NOW}) - epoch(created_at)) / 86400, 4) AS age FROM atoms")
def fn_age_days(t):
    return atoms(t).select("id", F.round(temporal.age_days(F.col("created_at"), now_()), 4).alias("age"))


@query("fn_try_timestamp", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(epoch(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 28 AS INT))) AS BIGINT) END AS at FROM documents")
def fn_try_timestamp(t):
    raw = F.when(F.col("doc_id") % 3 == 0, "no time").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")))
    return t.documents.select("doc_id", F.try_to_timestamp(raw).cast("long").alias("at"))


def duck_redact(column: str) -> str:
    out = column
    for code, p in text.SENSITIVE:
        out = f"regexp_replace({out}, '{p}', '[{code}]', 'g')"
    return out


@query("fn_redact", f"SELECT doc_id, md5({duck_redact('text')}) AS redacted, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{c}' END" for c, p in text.SENSITIVE) + "], lambda x: x IS NOT NULL), ',') AS codes FROM documents")
def fn_redact(t):
    return t.documents.select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted"), F.array_join(text.findings(F.col("text")), ",").alias("codes"))


@query("fn_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def fn_slug(t):
    return t.part.select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("fn_source_kind", "SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'note' WHEN regexp_matches(source, '^src[5-9]$') THEN 'log' ELSE 'other' END AS kind FROM documents")
def fn_source_kind(t):
    s = F.col("source")
    return t.documents.select("doc_id", F.when(s.rlike("^src[0-4]$"), "note").when(s.rlike("^src[5-9]$"), "log").otherwise("other").alias("kind"))


@query("fn_chunk_strategy", "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN 'whole' WHEN regexp_matches(text, '\\n') AND length(text) > 4000 THEN 'paragraph' WHEN regexp_matches(text, '[.!?]\\s') THEN 'sentence' ELSE 'char' END AS strategy FROM documents")
def fn_chunk_strategy(t):
    x = F.col("text")
    return t.documents.select("doc_id", F.when(F.length(x) <= 1000, "whole").when(x.rlike("\\n") & (F.length(x) > 4000), "paragraph").when(x.rlike("[.!?]\\s"), "sentence").otherwise("char").alias("strategy"))


@query("fn_document_id", "SELECT doc_id, sha256(concat_ws('|', source, substr(text, 1, 80), md5(text)))[1:24] AS stable_id FROM documents")
def fn_document_id(t):
    return t.documents.select("doc_id", F.substring(F.sha2(F.concat_ws("|", "source", F.substring("text", 1, 80), F.md5("text")), 256), 1, 24).alias("stable_id"))


@query("fn_canonical_source", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS canonical FROM pages")
def fn_canonical_source(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "/+$", "").alias("canonical"))


@query("fn_alias_merge", "SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct([source, lang, source, concat('a', doc_id % 3)])), lambda x: x), ',') AS aliases FROM documents")
def fn_alias_merge(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.concat(F.array("source", "lang"), F.array("source", F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string")))))), ",").alias("aliases"))


@query("fn_cue_hash", f"SELECT item_id, md5(array_to_string(list_sort({D('text')})[1:8], ' '))[1:12] AS cue FROM benchmark")
def fn_cue_hash(t):
    return t.benchmark.select("item_id", text.cue_hash(F.col("text")).alias("cue"))


_neg, _pos = (str(list(w)) for w in (text.NEGATIVE, text.POSITIVE))


@query("fn_polarity", f"WITH d AS (SELECT doc_id, {D('text', False)} AS x FROM documents) SELECT doc_id, CASE WHEN list_has_any(x, {_neg}) AND NOT list_has_any(x, {_pos}) THEN 'negative' WHEN list_has_any(x, {_pos}) AND NOT list_has_any(x, {_neg}) THEN 'positive' ELSE 'neutral' END AS polarity FROM d")
def fn_polarity(t):
    return t.documents.select("doc_id", text.polarity(text.tokens(F.col("text"), stop=())).alias("polarity"))


@query("fn_numbers", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')[1:6], ',') AS numbers, md5(regexp_replace(regexp_replace(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}', '', 'g'), '[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?', '', 'g')) AS bare FROM documents")
def fn_numbers(t):
    return t.documents.select("doc_id", F.array_join(F.slice(text.numbers(F.col("text")), 1, 6), ",").alias("numbers"), F.md5(text.without_datetimes(F.col("text"))).alias("bare"))


@query("fn_language_class", "SELECT CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END AS language, count(*) AS n FROM documents GROUP BY 1")
def fn_language_class(t):
    return t.documents.groupBy(text.language_class(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query("fn_signature", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', ' ', 'g'), '[0-9]+', ' ', 'g'), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g'))) AS signature FROM documents")
def fn_signature(t):
    return t.documents.select("doc_id", F.md5(text.signature(F.col("text"))).alias("signature"))


@query("fn_path_shape", "SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1), '/[0-9a-f]*[0-9][0-9a-f]*(/|$|\\?|\\.)', '/{id}\\1', 'g') AS shape FROM pages")
def fn_path_shape(t):
    return t.pages.select("page_id", text.path_shape(F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)?$", 1)).alias("shape"))


@query("fn_ndcg_mrr", "SELECT doc_id % 12 AS rank, max(CASE WHEN doc_id % 12 BETWEEN 1 AND 5 THEN round(1 / log2(doc_id % 12 + 1), 6) ELSE 0.0 END) AS ndcg, max(CASE WHEN doc_id % 12 > 0 THEN round(1.0 / (doc_id % 12), 6) ELSE 0.0 END) AS rr FROM documents GROUP BY 1")
def fn_ndcg_mrr(t):
    from palimpsest.operators.evaluation import ndcg_at, reciprocal_rank

    rank = F.col("doc_id") % 12
    return t.documents.groupBy(rank.alias("rank")).agg(F.max(F.round(ndcg_at(rank, 5), 6)).alias("ndcg"), F.max(F.round(reciprocal_rank(rank), 6)).alias("rr"))


@query("fn_ontology_resolve", "SELECT c_custkey, r_name AS kind, CASE WHEN n_nationkey IS NULL THEN 'unknown' ELSE 'known' END AS state FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def fn_ontology_resolve(t):
    known = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.customer.join(F.broadcast(known), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("r_name").alias("kind"), F.when(F.col("n_nationkey").isNull(), "unknown").otherwise("known").alias("state"))


@query("fn_user_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id")
def fn_user_text(t):
    own = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return own.select("conv_id", F.array_join(F.col("x.text"), "\n").alias("said"))


# -- filters

DSL = {"$or": [{"source": {"$in": ["src1", "src2", "src3"]}}, {"$and": [{"n_chars": {"$gte": 500, "$lt": 900}}, {"lang": {"$ne": "en"}}]}], "doc_id": {"$nin": [6, 8]}}


@query("flt_dsl", "SELECT doc_id, lang, source FROM documents WHERE (source IN ('src1','src2','src3') OR (n_chars >= 500 AND n_chars < 900 AND lang IS DISTINCT FROM 'en')) AND coalesce(doc_id NOT IN (6, 8), TRUE)")
def flt_dsl(t):
    return t.documents.where(filters.compile_filter(DSL)).select("doc_id", "lang", "source")


@query("flt_type_scope", f"WITH {ATOMS} SELECT id FROM atoms WHERE kind NOT IN ('raw_dump', 'event')")
def flt_type_scope(t):
    return atoms(t).where(filters.compile_filter({"kind": {"$nin": ["raw_dump", "event"]}})).select("id")


@query("flt_entity", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, substr(text, 1, 200))), 'tion')")
def flt_entity(t):
    return t.documents.where(F.lower(F.concat_ws(" ", "source", "lang", F.substring("text", 1, 200))).contains("tion")).select("doc_id")


@query("flt_hygiene", f"WITH {ATOMS} SELECT id, tier FROM atoms WHERE superseded_by IS NULL AND tier <> 'obsolete' AND NOT provisional AND (speaker = 'owner' OR starts_with(speaker, 'canonical')) AND scope <> 'session' AND (trust IS NULL OR trust >= 0.3) AND (valid_until IS NULL OR valid_until >= {NOW})")
def flt_hygiene(t):
    return atoms(t).where(filters.hygiene(now_())).select("id", "tier")


@query("flt_as_of", f"WITH {FACTS} SELECT id, entity, value FROM facts WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-01')")
def flt_as_of(t):
    return facts(t).where(temporal.valid_at(F.col("valid_from"), F.col("valid_to"), F.expr("TIMESTAMP '1996-06-01'"))).select("id", "entity", "value")


@query("flt_created_range", f"WITH {ATOMS} SELECT id FROM atoms WHERE created_at IS NULL OR (created_at >= TIMESTAMP '2024-03-01' AND created_at < TIMESTAMP '2024-04-01')")
def flt_created_range(t):
    c = F.col("created_at")
    return atoms(t).where(c.isNull() | ((c >= F.expr("TIMESTAMP '2024-03-01'")) & (c < F.expr("TIMESTAMP '2024-04-01'")))).select("id")


@query("flt_event_lookup", "SELECT event_id, event_type, value FROM events WHERE event_type LIKE 'p%' AND user_id < 200 ORDER BY ts DESC, event_id DESC LIMIT 50")
def flt_event_lookup(t):
    return t.events.where(F.col("event_type").like("p%") & (F.col("user_id") < 200)).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("flt_entity_facts", f"WITH {FACTS} SELECT id, attribute, value, round(confidence, 4) AS confidence FROM facts WHERE entity = 7 AND valid_to IS NULL ORDER BY facts.confidence DESC, id LIMIT 20")
def flt_entity_facts(t):
    return facts(t).where("entity = 7 AND valid_to IS NULL").orderBy(F.desc("confidence"), "id").limit(20).select("id", "attribute", "value", F.round("confidence", 4).alias("confidence"))


@query("flt_fact_history", f"WITH {FACTS} SELECT id, value, row_number() OVER (ORDER BY valid_from, id) AS version FROM facts WHERE entity = 7 AND attribute = '1-URGENT'")
def flt_fact_history(t):
    from pyspark.sql import Window

    own = facts(t).where("entity = 7 AND attribute = '1-URGENT'")
    return own.select("id", "value", F.row_number().over(Window.orderBy("valid_from", "id")).cast("long").alias("version"))


@query("flt_list_page", f"WITH {ATOMS} SELECT id, collection FROM atoms WHERE collection = 'semantic' ORDER BY id LIMIT 25 OFFSET 10")
def flt_list_page(t):
    return atoms(t).where("collection = 'semantic'").orderBy("id").offset(10).limit(25).select("id", "collection")


@query("flt_missing_keys", f"WITH {ATOMS} SELECT id, array_to_string(list_filter([CASE WHEN trust IS NULL THEN 'trust' END, CASE WHEN valid_until IS NULL THEN 'valid_until' END, CASE WHEN supersedes IS NULL THEN 'supersedes' END], lambda x: x IS NOT NULL), ',') AS missing FROM atoms")
def flt_missing_keys(t):
    keys = ("trust", "valid_until", "supersedes")
    return atoms(t).select("id", F.array_join(F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])), ",").alias("missing"))


@query("flt_normalise_hit", f"WITH {ATOMS} SELECT id, round(least(confidence * 100 * coalesce(trust, 0.7), 100), 2) AS score, length(substr(text, 1, 800)) AS shown FROM atoms")
def flt_normalise_hit(t):
    return atoms(t).select("id", F.round(F.least(F.col("confidence") * 100 * F.coalesce("trust", F.lit(0.7)), F.lit(100)), 2).alias("score"), F.length(F.substring("text", 1, 800)).cast("long").alias("shown"))


@query("flt_review_due", f"WITH {ATOMS} SELECT id, tier FROM atoms WHERE next_review <= {NOW} AND tier IN ('semantic', 'core') ORDER BY next_review, id LIMIT 40")
def flt_review_due(t):
    return atoms(t).where((F.col("next_review") <= now_()) & F.col("tier").isin("semantic", "core")).orderBy("next_review", "id").limit(40).select("id", "tier")


@query("flt_stale", f"WITH {AUDIT} SELECT session, count(*) AS n FROM audit GROUP BY session HAVING max(ts) < (SELECT max(ts) FROM audit) - INTERVAL 2 DAY")
def flt_stale(t):
    a = audit(t)
    newest = a.agg(F.max("ts").alias("newest"))
    return a.groupBy("session").agg(F.count("*").alias("n"), F.max("ts").alias("last")).join(F.broadcast(newest)).where(F.col("last") < F.col("newest") - F.expr("INTERVAL 2 DAY")).select("session", "n")


@query("flt_command_noise", "SELECT event_type, count(*) AS n FROM events WHERE NOT regexp_matches(event_type, '^(view|click)$') GROUP BY 1")
def flt_command_noise(t):
    return t.events.where(~F.col("event_type").rlike("^(view|click)$")).groupBy("event_type").agg(F.count("*").alias("n"))
