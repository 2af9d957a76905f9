"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import divergence, html, langid, licenses, media, mixing, packing, secrets, simhash, substring, topk, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(table(spark, sf_dir, "documents")), ("doc_id", "n_bytes"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs), ("doc_id",))
    return found.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _ = secrets.scan(table(spark, sf_dir, "documents"))
    base = paths.withColumn("base", F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return base.select(F.col("path").alias("doc_id"), *[count(r.kind) for r in secrets.BASE], F.sha2(secrets.told("base"), 256).alias("base_sha256"), secrets.told("spans").alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    told = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["kind"], x["start"], x["end"], x["differences"]))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(told, ",").alias("licenses"), F.array_max(F.col("licenses.saved")).alias("most_saved"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % topk.QUERY_EVERY == 0))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.transform("pieces", lambda x: F.concat_ws(":", x["slot"], x["rank"], x["place"], x["first"], x["words"]))
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.array_join(told, ",").alias("pieces"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_of(warc.read(spark, warc.write(table(spark, sf_dir, "pages")), payloads=False))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_pack": op1_pack,
        "op2_substring": op2_substring,
        "op3_media": op3_media,
        "op4_language": op4_language,
        "op5_html": op5_html,
        "op6_secrets": op6_secrets,
        "op7_simhash": op7_simhash,
        "op8_licenses": op8_licenses,
        "op9_topk": op9_topk,
        "op10_mix": op10_mix,
        "op11_warc": op11_warc,
        "op12_divergence": op12_divergence,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """The exact top-k, archives' digests and the divergence audit are plain SQL, in brute-force form; the others are tested
    against brute-force code."""
    return {
        "op9_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
                WHERE q.vec_id % 20 = 0
            ), r AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
        """,
        "op11_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (
                SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, first_value(page_id) OVER w AS top, row_number() OVER w AS k
                FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST)
            )
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
                array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
                CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
            FROM d
        """,
        "op12_divergence": r"""
            WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
            terms AS (
                SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
            ),
            kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
            langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
            own AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM terms t JOIN kept USING (lang, term) GROUP BY ALL),
            totals AS (SELECT g.lang, g.source, CAST(coalesce(sum(o.n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN own o USING (lang, source) GROUP BY ALL),
            p AS (
                SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 5)) // (s.total + 5 * l.v) AS p, 1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.v) AS q
                FROM totals s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
            ),
            sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            pairs AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
                FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            ),
            told AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM told)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
        """,
    }
