"""Best-fit packing of token sequences by a linear grouping scheme.

1. The lengths' histogram (at most one row per length, whatever the corpus) goes to the driver.
2. Large pieces are ranked by length and cut into groups of equal cardinality; each length is rounded up to its group's
   longest. With so few sizes, the configuration problem (how many sequences of each multiset of sizes) is solved by
   column generation; the rounded-down solution is filled up greedily.
3. Actual pieces take the places of rounded ones, longest first, so rounding costs only space that the small pieces use.
4. Small pieces go, longest first, each into the fullest sequence that still has room (best fit).

All of that is done on runs: "the n pieces of length L from rank r on lie in sequences s, s+1, ... at offset o". How many
runs there are depends on the lengths and groups, not on the documents; executors only look up each piece's run.

Nulls and odd cases: a null or empty text is the terminator alone, a sequence of length 1; repeated rows are packed each
for itself; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, hash_bucket, power_of_two, session_of, shuffle_parts, staged
from palimpsest.llm.tokens import chunks, word_tokenizer

CAPACITY = 2048
#: (groups, share of a sequence beyond which a piece is large): each is planned, and the plan with fewest sequences is kept.
SCHEMES = ((8, 1 / 3), (16, 1 / 3), (16, 1 / 4), (16, 1 / 2))
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path(tokenizer))
        for batch in batches:
            for first, after in chunks(batch["text"]):
                ids, ends = words.ids(batch["text"].slice(first, after - first))
                sizes = np.diff(ends)
                of = np.repeat(np.arange(len(sizes)), -(-sizes // capacity))
                piece = np.arange(len(of)) - np.searchsorted(of, of)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                at = (ends[of] + start).tolist()
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, length.tolist(), strict=True)]
                doc = batch["doc_id"].slice(first, after - first).take(pa.array(of))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------------------------------------------------------------
# On the driver, over the histogram


def linear_groups(large: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """large: (length, count), longest first -> (rounded length, count) of groups of equal cardinality."""
    total = sum(n for _, n in large)
    out: list[tuple[int, int]] = []
    size, left = -(-total // groups) if total else 0, 0
    for length, n in large:
        while n:
            if not left:
                out.append((length, 0))
                left = size
            took = min(n, left)
            out[-1] = (out[-1][0], out[-1][1] + took)
            n, left = n - took, left - took
    merged: dict[int, int] = {}
    for length, n in out:
        merged[length] = merged.get(length, 0) + n
    return sorted(merged.items(), reverse=True)


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most (an unbounded knapsack)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = sorted(range(len(sizes)), key=lambda k: sizes[k])
    for c in range(sizes[order[0]], capacity + 1):
        best[c], took[c] = best[c - 1], -1
        for k in order:
            if sizes[k] > c:
                break
            if (v := best[c - sizes[k]] + worth[k]) > best[c] + 1e-12:
                best[c], took[c] = v, k
    config, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            config[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), config


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, number of sequences) that hold `counts` pieces of the few `sizes`.

    Column generation over the fractional problem: the basis starts with single-size configurations, the duals price new
    ones by a knapsack, until none is worth more than its sequence. The whole parts are kept; what they leave is filled
    greedily, fullest configuration first.
    """
    if not sizes:
        return []
    n, need = len(sizes), np.array(counts, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(400):
        inverse = np.linalg.inv(basis)
        x, duals = inverse @ need, np.ones(n) @ inverse
        worth, config = best_configuration(sizes, np.maximum(duals, 0), capacity)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ config
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = config
    x = np.linalg.inv(basis) @ need
    plan: list[tuple[np.ndarray, int]] = []
    left = np.array(counts, dtype=np.int64)
    for column, times in zip(basis.T, x, strict=True):
        config = np.rint(column).astype(np.int64)
        times = min([int(times + 1e-9), *(int(left[k] // config[k]) for k in range(n) if config[k])])
        if times > 0:
            plan.append((config, times))
            left -= config * times
    while left.any():
        config, room = np.zeros(n, dtype=np.int64), capacity
        for k in range(n):  # longest first
            config[k] = min(left[k], room // sizes[k])
            room -= config[k] * sizes[k]
        times = min(int(left[k] // config[k]) for k in range(n) if config[k])
        plan.append((config, times))
        left -= config * times
    return plan


def plan_runs(histogram: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[int, int, int, int, int]]:
    """{length: count} -> runs (length, first rank, pieces, first sequence, offset).

    Each run puts pieces of one length, by rank, one into each of consecutive sequences, all at the same offset.
    """
    given = {length: 0 for length in histogram}  # ranks placed so far
    runs: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    used = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, given[length], n, first, offset))
        given[length] += n

    big = [(length, n) for length, n in sorted(histogram.items(), reverse=True) if length > capacity * large]
    grouped = linear_groups(big, groups)
    plan = configurations([s for s, _ in grouped], [n for _, n in grouped], capacity)
    # the actual pieces of each group, longest first, as [length, left]
    actual: list[list[list[int]]] = []
    rest = [[length, n] for length, n in big]
    for _, n in grouped:
        own: list[list[int]] = []
        while n:
            took = min(n, rest[0][1])
            own.append([rest[0][0], took])
            rest[0][1] -= took
            n -= took
            if not rest[0][1]:
                rest.pop(0)
        actual.append(own)
    for config, times in plan:
        slots = [k for k in range(len(config)) for _ in range(config[k])]
        # stretches of the sequences within which every slot's length stays the same
        stretches: list[tuple[int, list[int]]] = [(times, [])]
        for k in slots:
            split: list[tuple[int, list[int]]] = []
            for n, lengths in stretches:
                while n:
                    took = min(n, actual[k][0][1])
                    split.append((took, [*lengths, actual[k][0][0]]))
                    actual[k][0][1] -= took
                    n -= took
                    if not actual[k][0][1]:
                        actual[k].pop(0)
            stretches = split
        for n, lengths in stretches:
            offset = 0
            for length in lengths:
                put(length, n, used, offset)
                offset += length
            open_.setdefault(capacity - offset, []).append((used, n))
            used += n
    for length, n in sorted(((a, b) for a, b in histogram.items() if a <= capacity * large), reverse=True):
        while n:
            room = min((r for r in open_ if r >= length), default=0)
            if not room:
                each = capacity // length
                open_[capacity] = [(used, max(1, -(-n // each)))]
                used += open_[capacity][0][1]
                continue
            first, free = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = room // length
            full = min(free, n // each)
            if full < free:  # one sequence gets what is left, others stay as they are
                more = 1 if n > full * each else 0
                if free > full + more:
                    open_.setdefault(room, []).append((first + full + more, free - full - more))
                if more:
                    odd = n - full * each
                    for j in range(odd):
                        put(length, 1, first + full, capacity - room + j * length)
                    open_.setdefault(room - odd * length, []).append((first + full, 1))
                    n -= odd
            if full:
                for j in range(each):
                    put(length, full, first, capacity - room + j * length)
                open_.setdefault(room - each * length, []).append((first, full))
                n -= full * each
    return runs


def sequences(runs: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + n for _, _, n, first, _ in runs), default=0)


# ---------------------------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, schemes=SCHEMES, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = session_of(docs)
    pieces = staged(cut_pieces(docs, doc_id, text, capacity, tokenizer), "pack-pieces")
    bits = power_of_two(2 * shuffle_parts(spark))
    pieces = pieces.withColumn("bucket", hash_bucket(F.xxhash64("doc_id", "piece", "ids_crc32"), bits))
    counts = staged(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())  # at most `capacity` rows
    runs = sorted(min((plan_runs(histogram, capacity, *s) for s in schemes), key=sequences))
    starts = spark.sparkContext.broadcast(tuple(np.array(c, dtype=np.int64) for c in zip(*runs, strict=True)) if runs else None)

    below = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.withColumn("before", F.coalesce(below, F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1 + F.col("before")
    ranked = pieces.join(firsts, ["length", "bucket"]).withColumn("rank", rank.cast("long")).drop("before", "bucket")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                length, first, _, sequence, offset = starts.value
                key = (length << 48) + first
                at = np.searchsorted(key, (batch["length"].to_numpy() << 48) + batch["rank"].to_numpy(), side="right") - 1
                batch["sequence_id"] = sequence[at] + batch["rank"].to_numpy() - first[at]
                batch["offset"] = offset[at]
            else:
                batch["sequence_id"] = batch["offset"] = pd.Series(dtype="int64")
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
