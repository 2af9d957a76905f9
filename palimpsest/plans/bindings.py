"""How the engine's tables are bound to the given ones, for Spark and, for the oracles, as common table expressions.

Expressions are deterministic in the given rows; where both dialects read the same text, there is one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.session import Tables

NOW = "TIMESTAMP '2025-01-01 00:00:00'"

#: name, expression in Spark, and in DuckDB where it differs.
ATOM_FIELDS = [
    ("id", "doc_id"),
    ("text", "text"),
    ("path", "source"),
    ("topic_key", "concat(lang, '-', CAST(doc_id % 50 AS STRING))"),
    ("speaker", "CASE WHEN doc_id % 3 = 0 THEN 'owner' WHEN doc_id % 7 = 0 THEN 'canonical-note' ELSE source END"),
    ("scope", "CASE WHEN doc_id % 9 = 0 THEN 'session' ELSE 'global' END"),
    ("kind", "CASE doc_id % 6 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' WHEN 2 THEN 'preference' WHEN 3 THEN 'conjecture' WHEN 4 THEN 'event' ELSE 'raw_dump' END"),
    ("collection", "CASE doc_id % 7 WHEN 0 THEN 'canonical' WHEN 1 THEN 'semantic' WHEN 2 THEN 'experience' WHEN 3 THEN 'context' WHEN 4 THEN 'personal' WHEN 5 THEN 'knowledge' ELSE 'obsidian' END"),
    ("tier", "CASE WHEN doc_id % 11 = 0 THEN 'obsolete' WHEN doc_id % 5 = 0 THEN 'core' WHEN doc_id % 2 = 0 THEN 'semantic' ELSE 'episodic' END"),
    ("confidence", "CAST(doc_id % 97 AS DOUBLE) / 96"),
    ("trust", "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 31 AS DOUBLE) / 30 END"),
    ("quality", "CAST(doc_id % 17 AS DOUBLE) / 16"),
    ("easiness", "1.3 + CAST(doc_id % 13 AS DOUBLE) / 10"),
    ("reinforced", "CAST(doc_id % 8 AS INT)"),
    ("interval_days", "CAST(doc_id % 40 AS DOUBLE)"),
    ("accesses", "CAST(doc_id % 60 AS BIGINT)"),
    ("provisional", "doc_id % 19 = 0"),
    ("supersedes", "CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 ELSE NULL END"),
    ("superseded_by", "CASE WHEN doc_id % 10 = 2 THEN doc_id + 1 ELSE NULL END"),
    ("created_at", f"timestampadd(DAY, CAST(doc_id % 365 AS INT), TIMESTAMP '2024-01-01 00:00:00')", "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 365 AS INT))"),
    ("valid_until", "CASE WHEN doc_id % 4 = 0 THEN timestampadd(DAY, CAST(doc_id % 500 AS INT), TIMESTAMP '2024-02-01 00:00:00') ELSE NULL END", "CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' + to_days(CAST(doc_id % 500 AS INT)) ELSE NULL END"),
    ("next_review", "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE timestampadd(DAY, CAST(doc_id % 400 AS INT), TIMESTAMP '2024-03-01 00:00:00') END", "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE TIMESTAMP '2024-03-01 00:00:00' + to_days(CAST(doc_id % 400 AS INT)) END"),
]


def atoms(t: Tables) -> DataFrame:
    """Facts: a row per document."""
    return t.documents.selectExpr(*[f"{f[1]} AS {f[0]}" for f in ATOM_FIELDS])


ATOMS = "atoms AS (SELECT " + ", ".join(f"{f[-1]} AS {f[0]}" for f in ATOM_FIELDS) + " FROM documents)"


def audit(t: Tables) -> DataFrame:
    """The query log: a row per event, with the atom it served."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", "ts", F.col("user_id").alias("session"), F.col("event_type").alias("route"), F.col("value").alias("latency"), k.alias("atom"), (F.col("event_id") % 3).alias("actor"), F.expr("CASE WHEN value IS NULL THEN NULL WHEN event_id % 4 = 0 THEN 'wrong' WHEN event_id % 4 = 1 THEN 'right' WHEN event_id % 4 = 2 THEN 'ignored' ELSE NULL END").alias("outcome"))


AUDIT = "audit AS (SELECT event_id, ts, user_id AS session, event_type AS route, value AS latency, CAST(json_extract_string(props, '$.k') AS BIGINT) AS atom, event_id % 3 AS actor, CASE WHEN value IS NULL THEN NULL WHEN event_id % 4 = 0 THEN 'wrong' WHEN event_id % 4 = 1 THEN 'right' WHEN event_id % 4 = 2 THEN 'ignored' ELSE NULL END AS outcome FROM events)"


def edges(t: Tables) -> DataFrame:
    """The entity graph: customers (their keys) and suppliers (their keys below zero), with how often and how much they dealt."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"), F.least(F.lit(1.0), F.sum("l_quantity") / 100).alias("w"))


EDGES = "edges AS (SELECT o_custkey AS src, -1 - l_suppkey AS dst, count(*) AS n, max(l_shipdate) AS last, least(1.0, sum(l_quantity) / 100) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def facts(t: Tables) -> DataFrame:
    """Triples with validity: a customer's order status, from one order to the next."""
    from pyspark.sql import Window

    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("attribute"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("valid_from"), following.alias("valid_to"), (F.col("o_totalprice") % 100 / 100).alias("confidence"))


FACTS = "facts AS (SELECT o_orderkey AS id, o_custkey AS entity, o_orderpriority AS attribute, o_orderstatus AS value, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS valid_to, o_totalprice % 100 / 100 AS confidence FROM orders)"


def outcomes(t: Tables) -> DataFrame:
    """Decisions with outcome, by domain."""
    return t.lineitem.select(F.concat_ws("/", "l_returnflag", F.col("l_linenumber").cast("string")).alias("domain"), F.col("l_orderkey").alias("id"), (F.col("l_linestatus") == "F").alias("overridden"), (1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_tax") > 0.05, "late").otherwise("wrong").alias("reason"), F.col("l_shipdate").alias("ts"))


OUTCOMES = "outcomes AS (SELECT concat_ws('/', l_returnflag, CAST(l_linenumber AS STRING)) AS domain, l_orderkey AS id, l_linestatus = 'F' AS overridden, 1 - l_discount AS confidence, CASE WHEN l_tax > 0.05 THEN 'late' ELSE 'wrong' END AS reason, l_shipdate AS ts FROM lineitem)"

STOP = str(list(text.STOPWORDS))


def duck_tokens(of: str, stop: bool = True) -> str:
    every = f"list_distinct(regexp_extract_all(lower({of}), '[a-z0-9_\\-]{{2,}}|[가-힣]{{2,}}'))"
    return f"list_filter({every}, lambda x: NOT list_contains({STOP}, x))" if stop else every


def duck_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"


def duck_decay(created: str, collection: str, until: str) -> str:
    half = f"CASE {collection} WHEN 'personal' THEN 90.0 WHEN 'context' THEN 30.0 WHEN 'experience' THEN 180.0 WHEN 'semantic' THEN 365.0 WHEN 'patterns' THEN 90.0 END"
    age = f"greatest(0.0, (epoch({NOW}) - epoch({created})) / 86400.0)"
    return f"(CASE WHEN ({half}) IS NULL THEN 1.0 ELSE greatest(0.25, pow(0.5, {age} / ({half}))) END) * (CASE WHEN {until} < {NOW} THEN 0.3 ELSE 1.0 END)"


def now_():
    """The time that queries take for now."""
    return F.expr(NOW)
