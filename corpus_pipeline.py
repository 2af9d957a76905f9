"""From raw documents to packed sequences: language, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a DataFrame; all
but the last return the columns of documents. Rows without a letter are rejected by the first stage; of rows with one id
and text, the second keeps one; rows without an id are documents like any other. A document that the mix takes twice is
two rows from then on; one that it takes in part holds its first words. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, packing, secrets, simhash
from palimpsest.llm.common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    found = langid.identify(docs, langid.train(docs), tuple(docs.columns))
    return found.where(~F.col("rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's characters are replaced by a mark; documents without one stay as they are."""
    paths, _ = secrets.scan(docs)
    found = paths.where(F.size("spans") > 0).select(F.col("path").alias("_path"), F.col("blob").alias("_blob"), F.col("spans").alias("_spans")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_path")) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col("_blob"))
    joined = docs.join(found.hint("shuffle_hash"), same, "left")
    marked = secrets.redacted(F.col("text"), F.col("_spans"))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(marked)
    changed = joined.withColumn("text", text).withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return changed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes, in the order in which it comes to them first."""
    mixed = mixing.mix(docs, carry=tuple(docs.columns))
    taken = mixed.select("carried", "size", "source_key", "pieces", F.posexplode("passes").alias("pass", "n")).where("n > 0")
    first = F.element_at(F.filter("pieces", lambda x: x["pass"] == F.col("pass")), 1)
    taken = taken.withColumn("first", first).drop("pieces").orderBy("first.slot", "source_key", "first.rank", "first.place")
    row, cut = F.col("carried"), F.col("n") < F.col("size")
    text = F.when(cut, mixing.first_words(row["text"], F.col("n"))).otherwise(row["text"])
    new = {"text": text, "n_chars": F.when(cut, F.length(text)).otherwise(row["n_chars"]).cast("long")}
    return taken.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What goes where in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language models, fingerprints and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
