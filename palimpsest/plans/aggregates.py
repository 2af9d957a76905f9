"""Reports: conditional sums, rates, counters, rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.plans.bindings import ATOMS, AUDIT, FACTS, NOW, OUTCOMES, atoms, audit, facts, outcomes, now_
from palimpsest.plans.registry import query

count_if = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")


@query("agg_agency", f"WITH {OUTCOMES}, a AS (SELECT domain, count(*) AS n, count(*) FILTER (overridden) AS o FROM outcomes GROUP BY domain) SELECT domain, n, o AS overrides, round(o / n, 6) AS rate, CASE WHEN n < 50 THEN 'review' WHEN o / n > 0.15 THEN 'frozen' WHEN o / n < 0.05 THEN 'propose' ELSE 'review' END AS level FROM a")
def agg_agency(t):
    a = outcomes(t).groupBy("domain").agg(F.count("*").alias("n"), count_if(F.col("overridden")).alias("overrides"))
    rate = F.col("overrides") / F.col("n")
    return a.select("domain", "n", "overrides", F.round(rate, 6).alias("rate"), F.when(F.col("n") < 50, "review").when(rate > 0.15, "frozen").when(rate < 0.05, "propose").otherwise("review").alias("level"))


@query("agg_high_override", f"WITH {OUTCOMES} SELECT domain, count(*) AS n, round(count(*) FILTER (overridden) / count(*), 6) AS rate FROM outcomes GROUP BY domain HAVING count(*) >= 100 AND count(*) FILTER (overridden) / count(*) >= 0.5")
def agg_high_override(t):
    a = outcomes(t).groupBy("domain").agg(F.count("*").alias("n"), (count_if(F.col("overridden")) / F.count("*")).alias("rate"))
    return a.where("n >= 100 AND rate >= 0.5").select("domain", "n", F.round("rate", 6).alias("rate"))


@query("agg_override_patterns", f"WITH {OUTCOMES}, p AS (SELECT domain, reason, count(*) AS n, avg(confidence) AS c FROM outcomes WHERE overridden GROUP BY domain, reason), d AS (SELECT domain, count(*) AS total FROM outcomes GROUP BY domain) SELECT domain, reason, n, round(0.6 * n / total + 0.3 * c + 0.1 * least(1.0, n / 1000), 6) AS severity FROM p JOIN d USING (domain)")
def agg_override_patterns(t):
    o = outcomes(t)
    p = o.where("overridden").groupBy("domain", "reason").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    d = o.groupBy("domain").agg(F.count("*").alias("total"))
    severity = 0.6 * F.col("n") / F.col("total") + 0.3 * F.col("c") + 0.1 * F.least(F.lit(1.0), F.col("n") / 1000)
    return p.join(d, "domain").select("domain", "reason", "n", F.round(severity, 6).alias("severity"))


@query("agg_usefulness", "SELECT source, d.lang AS agent, CAST(grouping(d.lang) AS BIGINT) AS whole, count(*) AS n, CAST(sum(quality) AS BIGINT) AS useful, round(avg(quality), 6) AS rate FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((source), (source, d.lang))")
def agg_usefulness(t):
    j = t.documents.select("doc_id", "source", F.col("lang").alias("agent")).join(t.labels, "doc_id")
    return j.groupingSets([[F.col("source")], [F.col("source"), F.col("agent")]], "source", "agent").agg(F.grouping("agent").cast("long").alias("whole"), F.count("*").alias("n"), F.sum("quality").cast("long").alias("useful"), F.round(F.avg("quality"), 6).alias("rate"))


@query("agg_source_weight", "SELECT source, round(0.5 + sum(quality) / count(*), 6) AS weight FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 5")
def agg_source_weight(t):
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("u"))
    return j.where("n >= 5").select("source", F.round(0.5 + F.col("u") / F.col("n"), 6).alias("weight"))


@query("agg_recall_quality", f"WITH {AUDIT} SELECT atom, count(*) AS served, count(*) FILTER (outcome = 'right') AS good, count(*) FILTER (outcome = 'wrong') AS bad, round(count(*) FILTER (outcome = 'right') / nullif(count(*) FILTER (outcome IN ('right', 'wrong')), 0), 6) AS accuracy FROM audit WHERE atom IS NOT NULL GROUP BY atom")
def agg_recall_quality(t):
    o = F.col("outcome")
    a = audit(t).where("atom IS NOT NULL").groupBy("atom").agg(F.count("*").alias("served"), F.count(F.when(o == "right", 1)).alias("good"), F.count(F.when(o == "wrong", 1)).alias("bad"))
    return a.withColumn("accuracy", F.round(F.col("good") / F.nullif(F.col("good") + F.col("bad"), F.lit(0)), 6))


@query("agg_low_quality", f"WITH {AUDIT}, a AS (SELECT atom, count(*) FILTER (outcome = 'right') AS g, count(*) FILTER (outcome = 'wrong') AS b FROM audit GROUP BY atom) SELECT atom, g + b AS labelled FROM a WHERE g + b >= 3 AND g / (g + b) < 0.5")
def agg_low_quality(t):
    a = agg_recall_quality(t)
    return a.where("good + bad >= 3 AND good / (good + bad) < 0.5").select("atom", (F.col("good") + F.col("bad")).alias("labelled"))


@query("agg_wrong_slices", f"WITH {AUDIT} SELECT coalesce(route, CAST(actor AS STRING)) AS slice, CASE WHEN grouping(route) = 0 THEN 'route' ELSE 'actor' END AS dimension, count(*) AS n, round(avg(CASE WHEN outcome = 'wrong' THEN 1.0 ELSE 0.0 END), 6) AS wrong_rate FROM audit WHERE outcome IS NOT NULL GROUP BY GROUPING SETS ((route), (actor)) HAVING count(*) >= 5")
def agg_wrong_slices(t):
    a = audit(t).where("outcome IS NOT NULL").withColumn("bad", F.when(F.col("outcome") == "wrong", 1.0).otherwise(0.0))
    g = a.groupingSets([[F.col("route")], [F.col("actor")]], "route", "actor").agg(F.grouping("route").alias("g"), F.count("*").alias("n"), F.avg("bad").alias("r"))
    return g.where("n >= 5").select(F.coalesce("route", F.col("actor").cast("string")).alias("slice"), F.when(F.col("g") == 0, "route").otherwise("actor").alias("dimension"), "n", F.round("r", 6).alias("wrong_rate"))


COMPETITION = f"WITH {AUDIT}, s AS (SELECT session, atom, latency FROM audit WHERE atom IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY latency DESC, atom) AS rank FROM s), w AS (SELECT session, atom AS winner FROM r WHERE rank = 1), c AS (SELECT winner, atom AS loser, count(*) AS n FROM r JOIN w USING (session) WHERE rank > 1 AND atom <> winner GROUP BY ALL)"


def competitions(t):
    s = audit(t).where("atom IS NOT NULL").select("session", "atom", "latency")
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc_nulls_last("latency"), "atom")))
    w = r.where("rank = 1").select("session", F.col("atom").alias("winner"))
    return r.where("rank > 1").join(w, "session").where("atom <> winner").groupBy("winner", F.col("atom").alias("loser")).agg(F.count("*").alias("n"))


@query("agg_competition", COMPETITION.replace("latency DESC", "latency DESC NULLS LAST") + " SELECT winner, loser, n FROM c")
def agg_competition(t):
    return competitions(t)


@query("agg_inhibition", COMPETITION.replace("latency DESC", "latency DESC NULLS LAST") + " SELECT loser, CAST(sum(n) AS BIGINT) AS losses, count(DISTINCT winner) AS winners, round(greatest(-0.02 * log2(sum(n) + 1), -0.15), 6) AS weight FROM c GROUP BY loser HAVING sum(n) >= 3")
def agg_inhibition(t):
    a = competitions(t).groupBy("loser").agg(F.sum("n").alias("losses"), F.countDistinct("winner").alias("winners"))
    return a.where("losses >= 3").select("loser", "losses", "winners", F.round(F.greatest(-0.02 * F.log2(F.col("losses") + 1), F.lit(-0.15)), 6).alias("weight"))


@query("agg_monthly_usage", f"WITH {AUDIT} SELECT strftime(ts, '%Y-%m') AS month, route, count(*) AS n, round(sum(latency), 2) AS total FROM audit GROUP BY 1, 2")
def agg_monthly_usage(t):
    return audit(t).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "route").agg(F.count("*").alias("n"), F.round(F.sum("latency"), 2).alias("total"))


@query("agg_tier_growth", f"WITH {ATOMS} SELECT tier, count(*) AS n FROM atoms WHERE created_at >= {NOW} - INTERVAL 60 DAY GROUP BY tier")
def agg_tier_growth(t):
    return atoms(t).where(F.col("created_at") >= now_() - F.expr("INTERVAL 60 DAY")).groupBy("tier").agg(F.count("*").alias("n"))


@query("agg_fact_stats", f"WITH {FACTS} SELECT count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT attribute) AS attributes, count(*) FILTER (valid_to IS NULL) AS current FROM facts")
def agg_fact_stats(t):
    return facts(t).agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"), F.countDistinct("attribute").alias("attributes"), F.count(F.when(F.col("valid_to").isNull(), 1)).alias("current"))


@query("agg_event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_event_counts(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg_atom_counts", f"WITH {ATOMS} SELECT 'tier' AS dimension, tier AS value, count(*) AS n FROM atoms GROUP BY tier UNION ALL SELECT 'kind', kind, count(*) FROM atoms GROUP BY kind UNION ALL SELECT 'scope', scope, count(*) FROM atoms GROUP BY scope")
def agg_atom_counts(t):
    a = atoms(t).select(F.explode(F.create_map(F.lit("tier"), "tier", F.lit("kind"), "kind", F.lit("scope"), "scope")).alias("dimension", "value"))
    return a.groupBy("dimension", "value").agg(F.count("*").alias("n"))


@query("agg_usage_by_actor", f"WITH {AUDIT} SELECT actor, route, count(*) AS n, count(DISTINCT session) AS sessions FROM audit GROUP BY actor, route")
def agg_usage_by_actor(t):
    return audit(t).groupBy("actor", "route").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


@query("agg_json_counts", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def agg_json_counts(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("agg_outcome_stats", f"WITH {OUTCOMES} SELECT domain, reason, count(*) AS n, round(avg(confidence), 6) AS mean FROM outcomes GROUP BY domain, reason")
def agg_outcome_stats(t):
    return outcomes(t).groupBy("domain", "reason").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


@query("agg_confidence_stddev", f"WITH {ATOMS} SELECT tier, round(stddev_pop(confidence), 4) AS spread FROM atoms GROUP BY tier")
def agg_confidence_stddev(t):
    return atoms(t).groupBy("tier").agg(F.round(F.stddev_pop("confidence"), 4).alias("spread"))


@query("agg_domain_trust", "SELECT source, round((sum(quality) + 1) / (count(*) + 2), 6) AS trust FROM documents JOIN labels USING (doc_id) GROUP BY source")
def agg_domain_trust(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.round((F.sum("quality") + 1) / (F.count("*") + 2), 6).alias("trust"))


@query("agg_survival", f"WITH {ATOMS} SELECT kind, count(*) AS n, round(avg(CASE WHEN superseded_by IS NULL AND tier <> 'obsolete' THEN 1.0 ELSE 0.0 END), 6) AS survival FROM atoms GROUP BY kind")
def agg_survival(t):
    return atoms(t).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("superseded_by").isNull() & (F.col("tier") != "obsolete"), 1.0).otherwise(0.0)), 6).alias("survival"))


@query("agg_judgment_report", f"WITH {AUDIT} SELECT route, count(*) AS n, round(avg(CASE outcome WHEN 'right' THEN 1.0 WHEN 'wrong' THEN 0.0 END), 6) AS relevance, round(avg(latency), 4) AS latency, CASE WHEN avg(CASE outcome WHEN 'right' THEN 1.0 WHEN 'wrong' THEN 0.0 END) < 0.4 THEN 'tighten' WHEN avg(CASE outcome WHEN 'right' THEN 1.0 WHEN 'wrong' THEN 0.0 END) > 0.6 THEN 'loosen' ELSE 'keep' END AS advice FROM audit GROUP BY route")
def agg_judgment_report(t):
    relevance = F.avg(F.when(F.col("outcome") == "right", 1.0).when(F.col("outcome") == "wrong", 0.0))
    a = audit(t).groupBy("route").agg(F.count("*").alias("n"), relevance.alias("r"), F.round(F.avg("latency"), 4).alias("latency"))
    return a.select("route", "n", F.round("r", 6).alias("relevance"), "latency", F.when(F.col("r") < 0.4, "tighten").when(F.col("r") > 0.6, "loosen").otherwise("keep").alias("advice"))


@query("agg_decision_feedback", f"WITH {OUTCOMES} SELECT domain, reason, count(*) AS n, count(*) FILTER (overridden) AS failures, count(*) FILTER (overridden AND confidence >= 0.95) AS confident_failures FROM outcomes GROUP BY domain, reason HAVING count(*) FILTER (overridden) >= 5")
def agg_decision_feedback(t):
    bad = F.col("overridden")
    a = outcomes(t).groupBy("domain", "reason").agg(F.count("*").alias("n"), count_if(bad).alias("failures"), count_if(bad & (F.col("confidence") >= 0.95)).alias("confident_failures"))
    return a.where("failures >= 5")


@query("agg_goal_progress", "SELECT o_custkey % 40 AS goal, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS part FROM orders GROUP BY 1")
def agg_goal_progress(t):
    p = t.orders.groupBy((F.col("o_custkey") % 40).alias("goal")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("goal", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("F", "done"), ("O", "open"), ("P", "part"))])


@query("agg_running_accuracy", f"WITH {OUTCOMES}, d AS (SELECT domain, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (NOT overridden) AS ok FROM outcomes GROUP BY ALL) SELECT domain, CAST(day AS STRING) AS day, CAST(sum(ok) OVER w AS BIGINT) AS ok, CAST(sum(n) OVER w AS BIGINT) AS n FROM d WINDOW w AS (PARTITION BY domain ORDER BY day)")
def agg_running_accuracy(t):
    d = outcomes(t).groupBy("domain", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), count_if(~F.col("overridden")).alias("ok"))
    w = Window.partitionBy("domain").orderBy("day")
    return d.select("domain", F.col("day").cast("string").alias("day"), F.sum("ok").over(w).alias("ok"), F.sum("n").over(w).alias("n"))


@query("agg_recent_failures", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY user_id")
def agg_recent_failures(t):
    newest = t.events.agg(F.max("ts").alias("newest"))
    return t.events.where("event_type = 'error'").join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 24 HOUR")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("agg_error_clusters", f"WITH {ATOMS}, {AUDIT} SELECT topic_key, count(*) AS errors, count(DISTINCT id) AS members FROM audit JOIN atoms ON atom = id WHERE outcome = 'wrong' AND superseded_by IS NULL AND tier <> 'obsolete' GROUP BY topic_key HAVING count(*) >= 3")
def agg_error_clusters(t):
    live = atoms(t).where("superseded_by IS NULL AND tier <> 'obsolete'").select("id", "topic_key")
    a = audit(t).where("outcome = 'wrong'").join(live, F.col("atom") == F.col("id")).groupBy("topic_key").agg(F.count("*").alias("errors"), F.countDistinct("id").alias("members"))
    return a.where("errors >= 3")


@query("agg_access_frequency", f"WITH {AUDIT} SELECT atom, count(*) AS n FROM audit WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY AND atom IS NOT NULL GROUP BY atom")
def agg_access_frequency(t):
    newest = t.events.agg(F.max("ts").alias("newest"))
    return audit(t).where("atom IS NOT NULL").join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 30 DAY")).groupBy("atom").agg(F.count("*").alias("n"))


@query("agg_coactivation", f"WITH {AUDIT}, s AS (SELECT DISTINCT session, atom FROM audit WHERE atom IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY atom) AS k FROM s), m AS (SELECT * FROM r WHERE k <= 8) SELECT a.atom AS a, b.atom AS b, count(*) AS n FROM m a JOIN m b ON a.session = b.session AND a.atom < b.atom GROUP BY ALL")
def agg_coactivation(t):
    s = audit(t).where("atom IS NOT NULL").select("session", "atom").distinct()
    m = s.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("atom"))).where("k <= 8").select("session", "atom")
    return m.withColumnRenamed("atom", "a").join(m.withColumnRenamed("atom", "b"), "session").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("agg_episode_themes", "WITH c AS (SELECT conv_id, tok, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_\\-]{2,}|[가-힣]{2,}')) AS tok FROM conversations) WHERE length(tok) >= 5 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, tok) AS k FROM c) SELECT conv_id, string_agg(tok, ' ' ORDER BY k) AS theme FROM r WHERE k <= 3 GROUP BY conv_id")
def agg_episode_themes(t):
    from palimpsest.functions.text import token_list

    c = t.conversations.select("conv_id", F.explode(token_list(F.col("text"))).alias("tok")).where("length(tok) >= 5").groupBy("conv_id", "tok").agg(F.count("*").alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "tok"))).where("k <= 3")
    return r.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "tok")))["tok"], " ").alias("theme"))


@query("agg_growth_leaks", f"WITH {ATOMS}, g AS (SELECT collection, count(*) AS now_n, count(*) FILTER (created_at < {NOW} - INTERVAL 30 DAY) AS then_n FROM atoms GROUP BY collection) SELECT collection, now_n, then_n, now_n > 1.05 * then_n AS leak FROM g")
def agg_growth_leaks(t):
    g = atoms(t).groupBy("collection").agg(F.count("*").alias("now_n"), F.count(F.when(F.col("created_at") < now_() - F.expr("INTERVAL 30 DAY"), 1)).alias("then_n"))
    return g.withColumn("leak", F.col("now_n") > 1.05 * F.col("then_n"))


@query("agg_knowledge_gaps", "SELECT trim(regexp_replace(lower(text), '[^a-z ]', '', 'g')) AS asked, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) >= 2")
def agg_knowledge_gaps(t):
    asked = F.trim(F.regexp_replace(F.lower("text"), "[^a-z ]", ""))
    return t.conversations.where("role = 'user'").groupBy(asked.alias("asked")).agg(F.count("*").alias("n")).where("n >= 2")


@query("agg_focus", "SELECT CAST(isodow(ts) AS BIGINT) AS weekday, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def agg_focus(t):
    return t.events.groupBy((F.weekday("ts") + 1).cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("agg_storage", "WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT source, CAST(total AS BIGINT) AS total, doc_id, n_chars FROM r WHERE k <= 3")
def agg_storage(t):
    w = Window.partitionBy("source")
    top = t.documents.select("source", "doc_id", "n_chars").withColumn("k", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id"))).where("k <= 3").drop("k")
    return top.join(t.documents.groupBy("source").agg(F.sum("n_chars").alias("total")), "source")


@query("agg_memory_health", f"WITH {ATOMS} SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM atoms GROUP BY tier")
def agg_memory_health(t):
    a = atoms(t).groupBy("tier").agg(F.count("*").alias("n"))
    return a.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("agg_vote_consensus", f"WITH {AUDIT}, v AS (SELECT atom, outcome, count(*) AS n FROM audit WHERE outcome IS NOT NULL AND atom IS NOT NULL GROUP BY ALL), s AS (SELECT atom, sum(n) AS votes, max(n) AS top, min(outcome) FILTER (n = m) AS verdict FROM (SELECT *, max(n) OVER (PARTITION BY atom) AS m FROM v) GROUP BY atom) SELECT atom, CAST(votes AS BIGINT) AS votes, verdict FROM s WHERE votes >= 3 AND top >= 2")
def agg_vote_consensus(t):
    v = audit(t).where("outcome IS NOT NULL AND atom IS NOT NULL").groupBy("atom", "outcome").agg(F.count("*").alias("n"))
    s = v.groupBy("atom").agg(F.sum("n").alias("votes"), F.max("n").alias("top"), F.min(F.struct((-F.col("n")).alias("n"), "outcome"))["outcome"].alias("verdict"))
    return s.where("votes >= 3 AND top >= 2").select("atom", "votes", "verdict")


@query("agg_hypotheses", f"WITH {AUDIT} SELECT atom % 50 AS hypothesis, round((count(*) FILTER (outcome = 'right') + 1) / (count(*) FILTER (outcome IN ('right', 'wrong')) + 2), 6) AS confidence FROM audit WHERE atom IS NOT NULL GROUP BY 1")
def agg_hypotheses(t):
    o = F.col("outcome")
    return audit(t).where("atom IS NOT NULL").groupBy((F.col("atom") % 50).alias("hypothesis")).agg(F.round((F.count(F.when(o == "right", 1)) + 1) / (F.count(F.when(o.isin("right", "wrong"), 1)) + 2), 6).alias("confidence"))


@query("agg_subjects", f"WITH {ATOMS} SELECT speaker, count(*) AS n, count(*) FILTER (kind = 'fact') AS facts FROM atoms GROUP BY speaker")
def agg_subjects(t):
    return atoms(t).groupBy("speaker").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "fact", 1)).alias("facts"))


@query("agg_stale_ratio", f"WITH {ATOMS} SELECT collection, round(avg(CASE WHEN created_at < {NOW} - INTERVAL 180 DAY THEN 1.0 ELSE 0.0 END), 6) AS stale, count(*) FILTER (confidence < 0.3) AS low FROM atoms GROUP BY collection")
def agg_stale_ratio(t):
    return atoms(t).groupBy("collection").agg(F.round(F.avg(F.when(F.col("created_at") < now_() - F.expr("INTERVAL 180 DAY"), 1.0).otherwise(0.0)), 6).alias("stale"), F.count(F.when(F.col("confidence") < 0.3, 1)).alias("low"))


@query("agg_domain_index", "SELECT lang, array_to_string(list_sort(list(doc_id))[1:20], ',') AS first FROM documents GROUP BY lang")
def agg_domain_index(t):
    ranked = t.documents.select("lang", "doc_id").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("k <= 20")
    return ranked.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first"))


@query("agg_inverted_index", "SELECT tok AS token, count(DISTINCT item_id) AS items FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_\\-]{2,}|[가-힣]{2,}')) AS tok FROM benchmark) GROUP BY tok")
def agg_inverted_index(t):
    from palimpsest.functions.text import token_list

    return t.benchmark.select("item_id", F.explode(token_list(F.col("text"))).alias("token")).groupBy("token").agg(F.countDistinct("item_id").alias("items"))


@query("agg_night_work", "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n FROM events WHERE hour(ts) >= 22 OR hour(ts) < 5 GROUP BY 1 HAVING count(*) >= 3")
def agg_night_work(t):
    h = F.hour("ts")
    return t.events.where((h >= 22) | (h < 5)).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n")).where("n >= 3")


@query("agg_metric_means", "SELECT event_type AS metric, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg_metric_means(t):
    return t.events.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("mean"))
