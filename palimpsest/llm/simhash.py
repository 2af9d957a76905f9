"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint of 64 bits is cut into two halves of 16 segments of two bits, and each half is mapped to the vector of its
segments' bit counts, a point on a small lattice. A flipped bit moves one count by one, so Manhattan distance between
two points is a lower bound of the Hamming distance of what they came from. Fingerprints at 4 or fewer differing bits are
therefore within Manhattan distance 2 in one half at least; and lattice points that close share a point within distance 1
of both. So each fingerprint is registered in the grid cell of its own point and of every neighbouring point, for each
half, and fingerprints that meet in a cell are verified exactly. A crowded cell is cut first by five bands of the bits,
one of which two fingerprints at 4 differing bits share.

Documents with one fingerprint are one vertex from the start. Within a cell, verified links are merged at once, and only
a tree of few children a node is kept: enough to hold the linked fingerprints together, however many they are, without a
vertex that gathers all of them. Components are then the least labels that spread over these trees; all vertices of one
label move on together, so that the rounds grow with the logarithm of a chain's length.

Nulls and odd cases: null and empty texts have the fingerprint zero and are linked like any other; repeated rows share
their fingerprint; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, hot_safe_join, session_of, shuffle_parts, staged

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Children of a node in the trees that hold a cell's linked fingerprints together.
CHILDREN = 4
#: Fingerprints of a cell beyond which it is cut by bands; and the bands, of DISTANCE + 1 stretches of the 64 bits.
CROWDED = 2048
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, n, SHINGLES_AT_ONCE):
        some = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : min(n, k + SHINGLES_AT_ONCE)], stops[k : k + SHINGLES_AT_ONCE], strict=True)], dtype="<u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the carried columns."""
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64)), *(batch[c] for c in carry)], names=["doc_id", "fp", *carry])
        give_back()

    return held.mapInArrow(work, held.select("doc_id", F.lit(0).cast("long").alias("fp"), *carry).schema)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, fingerprints): each fingerprint with the grid cells of its own lattice points and of their neighbours."""
    bits = fps.view(np.uint64)
    counts = (bits & np.uint64(0x5555555555555555)) + ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))  # a count of 0 to 2 in each two bits
    out, own = [], []
    for half in (0, 1):
        point = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half << 32)
        out.append(point | tag)
        own.append(bits)
        for k in range(16):
            count = (point >> np.uint64(2 * k)) & np.uint64(3)
            one = np.uint64(1 << (2 * k))
            for step, may in ((1, count < 2), (-1, count > 0)):
                out.append(((point[may] + one) if step > 0 else (point[may] - one)) | tag)
                own.append(bits[may])
    return np.concatenate(out).view(np.int64), np.concatenate(own).view(np.int64)


def cell_trees(own: np.ndarray, distance: int = DISTANCE, crowded: int = CROWDED) -> list[tuple[int, int]]:
    """own: a cell's different fingerprints -> edges of trees, one for each set that verified links hold together.

    Compares row by row of the cell, in numpy; only trees leave it. A crowded cell is compared within the values of each
    band: of at most len(own) - 1 edges a band.
    """
    left, edges = np.sort(own.view(np.uint64)), []
    if len(left) > crowded:
        for at, bits in BANDS:
            band = (left >> np.uint64(at)) & np.uint64((1 << bits) - 1)
            order = np.argsort(band, kind="stable")
            for part in np.split(left[order], np.flatnonzero(np.diff(band[order])) + 1):
                edges += cell_trees(part, distance, len(part))
        return edges
    while len(left) > 1:
        group, at = left[:1], 0
        left = left[1:]
        while at < len(group) and len(left):
            near = np.bitwise_count(left ^ group[at]) <= distance
            if near.any():
                group, left = np.concatenate([group, left[near]]), left[~near]
            at += 1
        if len(group) > 1:
            ordered = np.sort(group).view(np.int64).tolist()
            edges += [(ordered[(k - 1) // CHILDREN], ordered[k]) for k in range(1, len(ordered))]
    return edges


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """distinct (fp) -> edges (a, b) that hold together what links at `distance` or fewer bits hold together."""
    if distance > 4:
        raise ValueError("two halves with neighbours at one step find links of up to 4 bits")

    def register(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, fp = cells(np.ascontiguousarray(batch["fp"].to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp)], names=["cell", "fp"])
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # what there is of a cell that may go on in the next batch

        def of(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, dtype=int)
            last = np.append(first[1:], len(cell))
            edges = [e for a, b in zip(first.tolist(), last.tolist(), strict=True) if b - a > 1 for e in cell_trees(fp[a:b], distance)]
            a, b = zip(*edges, strict=True) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def all_held() -> pa.RecordBatch:
            return of(np.concatenate([c for c, _ in held]), np.concatenate([f for _, f in held]))

        for batch in batches:
            cell, fp = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "fp"))
            if not len(cell):
                continue
            stop = int(np.searchsorted(cell, cell[-1]))
            if held and (stop or held[-1][0][-1] != cell[-1]):  # the cell that was held ends here
                held.append((cell[:stop], fp[:stop]))
                yield all_held()
                held = [(cell[stop:], fp[stop:])]
            else:
                if stop:
                    yield of(cell[:stop], fp[:stop])
                held.append((cell[stop:], fp[stop:]))
        if held:
            yield all_held()
        give_back()

    parts = 2 * shuffle_parts(session_of(distinct))
    registered = distinct.mapInArrow(register, "cell long, fp long")
    return registered.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (fp, root): every vertex of an edge with a label that all of its component share, and no other.

    Each round the vertices of one label look for the least label next to any of them, and all of them take it, or that
    label's own next one. Edges have few ends at any vertex; a label that many vertices share is aggregated and salted.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root")), "simhash-labels")
    total = labels.count()
    while True:
        beside = both.join(labels.withColumnRenamed("fp", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        least = labels.join(beside.withColumnRenamed("a", "fp"), "fp").groupBy("root").agg(F.min("m").alias("m"), F.count("*").alias("rows"))
        own = labels.select(F.col("fp").alias("root"), F.col("root").alias("own"))
        hooks = staged(least.join(own, "root").select("root", "rows", F.least("root", "m", "own").alias("to")), "simhash-hooks")
        if not hooks.where("to < root").limit(1).count():
            return labels
        onward = hooks.groupBy(F.col("to").alias("root")).agg(F.count("*").alias("n")).join(hooks.select("root", F.col("to").alias("next")), "root")
        jumped = hot_safe_join(hooks.withColumnRenamed("root", "from").withColumnRenamed("to", "root"), onward, "root", "n", F.col("from"), total)
        jumped = jumped.select(F.col("from").alias("root"), "rows", F.col("next").alias("to"))
        labels = staged(hot_safe_join(labels, jumped, "root", "rows", F.col("fp"), total).select("fp", F.col("to").alias("root")), "simhash-labels")


def grouped(held: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """held (doc_id, fp, ...) with root, the component's label, and component_id, its smallest doc_id."""
    classes = staged(held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs")), "simhash-classes")
    labels = components(links(classes.select("fp"), distance))
    named = classes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    total = held.count()
    classes_of = hot_safe_join(named, roots, "root", "classes", F.col("fp"), max(1, total))
    classes_of = staged(classes_of.select("fp", "docs", "root", "component_id"), "simhash-components")
    return hot_safe_join(held, classes_of, "fp", "docs", F.col("doc_id"), total)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """A row per document: doc_id, fingerprint, component_id."""
    joined = grouped(staged(fingerprints(docs, doc_id, text), "simhash-fingerprints"), distance)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near duplicates, whole: the one with the smallest id, null ids last; of rows with one
    id, the one whose text comes first by hash. Rows without an id, and different texts with one id, are judged alike."""
    key = lambda: F.struct(*[F.xxhash64(F.lit(salt), F.col(doc_id), F.col(text)).alias(f"h{salt}") for salt in (0, 1)])
    held = staged(fingerprints(docs.withColumn("_key", key()), doc_id, text, ("_key",)), "simhash-fingerprints")
    chosen = grouped(held).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first")).select(F.col("first._key").alias("_chosen"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_whole"), key().alias("_key"))
    kept = whole.join(chosen.hint("shuffle_hash"), F.col("_key") == F.col("_chosen"), "left_semi")
    kept = kept.withColumn("_row", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))).where("_row = 1")
    return kept.select(*[F.col("_whole")[c].alias(c) for c in docs.columns])
