"""Language identification by the nearest of several centroids per language.

A text is a bag of hashed character n-grams (one to three letters, with word ends), weighted by TF-IDF and normalised to
length 1. Each language has a few centroids, found by spherical k-means over its labelled texts. A text gets the language
of the centroid with the highest cosine; it is rejected if even that one is further off than the language's own texts
ever are, with a margin.

What is fitted (document frequencies, centroids, margins) comes from a bounded sample: up to `per_language` different
labelled texts of each language, those whose hash is least, and MOST_ROWS in all. Choosing the sample and predicting cover
all rows; ids have no say in either, beyond who is held out.

Nulls and odd cases: a null text, or one without any letter, is `und` with score 0 and rejected; rows without a language
teach nothing; with no labelled row to learn from, everything is `und` and, if it has a letter, kept; repeated texts count
as often as they come; rows without an id, or with one
id, are rows like any; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SALTS, give_back, staged

DIMENSIONS = 2048
CENTROIDS = 4
#: Different labelled texts of each language that the model is fitted on, at most; in all languages together; and labels.
PER_LANGUAGE = 1200
MOST_ROWS = 12_000
MOST_LABELS = 2_000
ROUNDS = 12
#: A text is rejected if its cosine is below this part of the lowest that any fitted text of the language has.
MARGIN = 0.4
UNDETERMINED = "und"
ROWS_AT_ONCE = 256
CHARS_AT_ONCE = 500_000
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def gram_counts(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x dimensions) counts of hashed n-grams, and whether each text has a letter."""
    counts, has = np.zeros((len(texts), dimensions), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    at = 0
    while at < len(texts):
        stop, held = at + 1, len(texts[at])
        while stop < len(texts) and stop - at < ROWS_AT_ONCE and held + len(texts[stop]) <= CHARS_AT_ONCE:
            held += len(texts[stop])
            stop += 1
        part = [t.lower() for t in texts[at:stop]]
        codes = np.frombuffer("".join(f"  {t}  " for t in part).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        row = np.repeat(np.arange(len(part)), [len(t) + 4 for t in part])
        letter = letters()[codes]
        has[at:stop] = np.bincount(row[letter], minlength=len(part)) > 0
        codes = np.where(letter, codes, 32)
        total = np.zeros(len(part) * dimensions)
        shift = np.uint32(32 - (dimensions.bit_length() - 1))
        for size, salt in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
            n, mixed, some = len(codes) - size + 1, np.zeros(len(codes) - size + 1, dtype=np.uint32), np.zeros(len(codes) - size + 1, dtype=bool)
            for k in range(size):
                mixed = (mixed ^ codes[k : k + n]) * np.uint32(salt)
                mixed ^= mixed >> np.uint32(15)
                some |= letter[k : k + n]
            some &= row[:n] == row[size - 1 :]
            total += np.bincount(row[:n][some] * dimensions + (mixed[some] * np.uint32(0x27D4EB2F) >> shift), minlength=len(total))
        counts[at:stop] = total.reshape(len(part), dimensions)
        at = stop
    return counts, has


@dataclass
class Model:
    """What is fitted: weights of the n-grams, unit centroids, each one's language, each language's lowest cosine."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.sqrt(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """language, score and rejection of each text."""
        counts, has = gram_counts([t or "" for t in texts])
        if not len(self.of):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), ~has
        near = self.vectors(counts) @ self.centroids.T
        best = near.argmax(axis=1) if len(texts) else np.zeros(0, dtype=int)
        score = np.where(has, np.clip(near[np.arange(len(texts)), best], 0, 1), 0).astype(float)
        far = score < self.floors[self.of[best]]
        return [self.languages[self.of[b]] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)], score, far | ~has


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def clustered(x: np.ndarray, weights: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of weighted rows: each next first centroid is the row least like those chosen before."""
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        centroids = unit(np.stack([weights[own == c] @ x[own == c] if (own == c).any() else centroids[c] for c in range(len(centroids))]))
    return centroids


def fit(languages: list[str], counts: np.ndarray, centroids: int = CENTROIDS, margin: float = MARGIN, weights: np.ndarray | None = None) -> Model:
    """languages, counts, weights (how many rows have the text): of labelled texts, in an order that doesn't depend on the
    run."""
    weights = np.ones(len(languages), dtype=np.float32) if weights is None else weights.astype(np.float32)
    names = sorted(set(languages))
    if not names:
        return Model([], np.ones(DIMENSIONS, dtype=np.float32), np.zeros((0, DIMENSIONS), dtype=np.float32), np.zeros(0, dtype=int), np.zeros(0))
    idf = (np.log((1 + weights.sum()) / (1 + weights @ (counts > 0))) + 1).astype(np.float32)
    model, labels = Model(names, idf, np.zeros((0, counts.shape[1]), dtype=np.float32), np.zeros(0, dtype=int), np.zeros(len(names))), np.array(languages)
    found = []
    for k, name in enumerate(names):  # a language at a time, to hold few vectors at once
        own = model.vectors(counts[labels == name])
        found.append(clustered(own, weights[labels == name], centroids))
        model.floors[k] = margin * (own @ found[-1].T).max(axis=1).min()
    model.centroids, model.of = np.concatenate(found), np.repeat(np.arange(len(names)), [len(f) for f in found])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, key, rows, text: of each language the `per_language` different texts of least hash, of labelled rows that are not
    held out; fewer if that is more than MOST_ROWS in all, and of more than MOST_LABELS labels those with most rows; rows:
    how many have the text. Neither ids nor copies of a text have a say in what is drawn."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(doc_id)), F.lit(False)))
    labelled = labelled.select(F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    keys = labelled.groupBy("lang", "key").agg(F.count("*").alias("rows"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("key"))
    first = keys.withColumn("salt", F.pmod("key", F.lit(SALTS))).withColumn("rank", rank("salt")).where(F.col("rank") <= per_language)  # so that a language is many tasks
    least = staged(first.drop("salt").withColumn("rank", rank()).where(F.col("rank") <= per_language), "language-keys")
    labels = least.where("rank = 1").count()
    if labels > MOST_LABELS:
        sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MOST_LABELS).select("lang")
        least, labels = least.join(sizes, "lang", "left_semi"), MOST_LABELS
    least = least.where(F.col("rank") <= max(1, MOST_ROWS // max(1, labels))).select("lang", "key", "rows")
    return labelled.join(F.broadcast(least), ["lang", "key"]).groupBy("lang", "key", "rows").agg(F.first("text").alias("text"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a sample of labelled rows. The driver gets their n-gram counts, compressed: MOST_ROWS rows at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                counts, has = gram_counts(part["text"].to_pylist())
                packed = [zlib.compress(c.astype("<f4").tobytes(), 1) if h else None for c, h in zip(counts, has, strict=True)]
                yield pa.RecordBatch.from_arrays([part["lang"], part["key"], part["rows"], pa.array(packed, pa.binary())], names=["lang", "key", "rows", "counts"])
        give_back()

    found = sample(docs, doc_id, text, lang, per_language).mapInArrow(work, "lang string, key long, rows long, counts binary").where("counts is not null")
    rows = sorted(((r["lang"], r["key"], r["rows"], bytes(r["counts"])) for r in found.collect()), key=lambda r: r[:2])
    counts = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for k, (*_, packed) in enumerate(rows):
        counts[k] = np.frombuffer(zlib.decompress(packed), dtype="<f4")
    model = fit([r[0] for r in rows], counts, weights=np.array([r[2] for r in rows], dtype=float))
    del counts, rows
    give_back()
    return model


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Every row's language: the carried columns, then lang_pred, score, rejected. Only the text is looked at."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    inside = text in carry  # then it isn't sent twice
    held = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried")
    fields = docs.select(held).schema["carried"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                texts = pc.struct_field(part["carried"], [carry.index(text)]) if inside else part["text"]
                names, score, rejected = shared.value.predict(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part["carried"], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["carried", "lang_pred", "score", "rejected"])
        give_back()

    found = docs.select(held, *[] if inside else [F.col(text).alias("text")]).mapInArrow(work, f"carried {fields}, lang_pred string, score double, rejected boolean")
    return found.select(*[F.col("carried")[c].alias(c) for c in carry], "lang_pred", "score", "rejected")
