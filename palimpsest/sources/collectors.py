"""Readers of files: notes with a JSON head, JSON records, session logs, shell history, whole texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "timestamp", "source_type", "source_ref", "actor", "visibility", "scrub_status", "content")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("attachments", "entities")]
    + [T.StructField("hash", T.StringType())]
)
HEAD = r"(?s)^---\s*\n(\{.*?\})\s*\n---\s*\n?(.*)$"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Inbox records, one JSON document a file; a record that can't be read has nulls, and goes."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("id IS NOT NULL")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """path, head (string to string), body of notes; notes whose head isn't JSON go."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return parsed_notes(raw)


def parsed_notes(raw: DataFrame) -> DataFrame:
    head = F.from_json(F.regexp_extract("text", HEAD, 1), "map<string,string>", {"mode": "PERMISSIVE"})
    return raw.select("path", head.alias("head"), F.regexp_extract("text", HEAD, 2).alias("body")).where("head IS NOT NULL AND size(head) > 0")


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of session logs: role, time, and the text of their content, a string or blocks of which those of type text count."""
    schema = "type string, timestamp string, sessionId string, message struct<role string, content string>"
    x = spark.read.text(path).select(F.from_json("value", schema).alias("x")).select("x.*")
    blocks = F.from_json(F.col("message.content"), "array<struct<type string, text string>>")
    said = F.when(F.col("message.content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("message.content"))
    return x.select(F.col("sessionId").alias("session"), F.try_to_timestamp("timestamp").alias("at"), F.col("message.role").alias("role"), said.alias("text")).where("text IS NOT NULL")


def shell_history(lines: DataFrame, column: str = "value") -> DataFrame:
    """at, seconds, command of extended history lines `: 1700000000:5;command`; others go."""
    form = r"^: (\d+):(\d+);(.*)$"
    return lines.where(F.col(column).rlike(form)).select(F.regexp_extract(column, form, 1).cast("long").alias("at"), F.regexp_extract(column, form, 2).cast("long").alias("seconds"), F.regexp_extract(column, form, 3).alias("command"))


def chunk_text(text: str, size: int = 1000, overlap: int = 200) -> Iterator[str]:
    """Pieces of at most `size` characters: whole paragraphs while they fit, else sentences, else characters; each piece
    but the first starts with the last `overlap` characters, at most, of the one before it."""
    units: list[str] = []
    for paragraph in text.split("\n\n"):
        if len(paragraph) <= size - overlap:
            units.append(paragraph + "\n\n")
            continue
        held = ""
        for sentence in paragraph.replace("! ", "!\0").replace("? ", "?\0").replace(". ", ".\0").split("\0"):
            units += [x for x in [held] if x and len(held) + len(sentence) + 1 > size - overlap]
            held = sentence + " " if len(held) + len(sentence) + 1 > size - overlap else held + sentence + " "
            while len(held) > size - overlap:
                units.append(held[: size - overlap])
                held = held[size - overlap :]
        if held:
            units.append(held + "\n")
    piece, tail = "", ""
    for unit in units:
        if piece and len(tail) + len(piece) + len(unit) > size:
            yield (tail + piece).strip()
            tail, piece = (tail + piece)[-overlap:] if overlap else "", ""
        piece += unit
    if piece.strip():
        yield (tail + piece).strip()


def chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, chunk_no, chunk, and an id that depends on the content only."""
    import pandas as pd

    def work(batches):
        for batch in batches:
            rows = [(k, n, c) for k, t in zip(batch["key"], batch["text"], strict=True) for n, c in enumerate(chunk_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(work, f"key {kind}, chunk_no int, chunk string")
    return out.select(F.col("key").alias(key), "chunk_no", "chunk", F.substring(F.sha2(F.concat_ws("|", F.col("key").cast("string"), F.col("chunk_no").cast("string"), "chunk"), 256), 1, 32).alias("chunk_id"))
