"""Substring dedup: remove every word that a repeated window of words covers, with a count-min prefilter.

Documents are laid out once as blocks of some megabytes, in a table bucketed by block, so that no later pass moves text.

1. Each block counts its windows in a partition sketch: two count-min rows, whose width grows with the corpus, so that
   a sketch is sparse and travels as sorted positions, dealt by ranges of positions ("shards"). A shard merges all
   blocks' sketches, counting to two, and answers each block with a bit per position: met again, or not. A sketch can
   only overestimate, so no repeated window is lost.
2. Only windows that both rows estimate as repeated are grouped exactly, by the 128-bit digest of their words.
3. Each block removes the words that its exactly repeated windows cover.

What a block sends about a window is one row however often the block has it, so a passage that every document holds
costs a shard no more than one row a block.

A block's steps keep a few values a word, and what is large for a moment is made in slices: keys by runs of bytes, digests
and look-ups by runs of windows. So a worker's memory grows by a few digests for each repeated window at most, and with a text
longer than a block by a few values a word. Workers return free memory after each group of rows.

Nulls and odd cases: a null or empty text has no words; a text shorter than a window loses none; repeated rows are copies
of each other, and all their words in windows go; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, session_of, shared_folder, shuffle_parts, staged

WINDOW = 35
BLOCK_BYTES = 6_000_000
#: Bytes of a block that are hashed at once, or as many as one window has.
KEY_BYTES = 250_000
#: Windows that are digested or looked up at once.
WINDOWS_AT_ONCE = 20_000
#: Positions of a sketch row for each window of the corpus, at least.
SPARSE = 4
ROWS = 2
SHARD_BITS = 22
#: A shard of exact groups has windows of so much less of the corpus than one of a sketch.
FINER = 3
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

U = np.uint64


class Block:
    """A block's documents: ids, and their words, single-spaced, in one run of bytes."""

    def __init__(self, payload: bytes, window: int):
        table = pa.ipc.open_stream(zlib.decompress(payload)).read_all()
        self.doc_ids, texts = table["doc_id"].to_pylist(), table["words"].to_pylist()
        del table
        self.window, self.bytes = window, b" ".join([t for t in texts if t])
        self.words = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
        del texts
        index = np.int32 if len(self.bytes) < (1 << 31) - 1 else np.int64
        spaces = np.flatnonzero(np.frombuffer(self.bytes, dtype=np.uint8) == 32)
        self.starts = np.zeros(int(self.words.sum()) + 1, dtype=index)  # of words, and where a next one would start
        self.starts[1:-1] = spaces
        self.starts[1:-1] += 1
        self.starts[-1] = len(self.bytes) + 1
        del spaces
        doc, n = np.repeat(np.arange(len(self.words), dtype=index), self.words), max(0, len(self.starts) - window)
        self.at = np.flatnonzero(doc[:n] == doc[window - 1 :][:n]).astype(index)  # words at which a window starts

    def spans(self, of: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """The first bytes of some windows, and the bytes after their last ones."""
        at = self.at[of]
        return self.starts[at], self.starts[at + self.window] - 1

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each window's words: a difference of prefix sums, shifted to start at power 0."""
        every, out = np.frombuffer(self.bytes, dtype=np.uint8), np.zeros(len(self.at), dtype=U)
        x = 0
        while x < len(out):
            begin, end = self.spans(slice(x, x + 1))
            a = int(begin[0])
            word = np.searchsorted(self.starts, self.starts.dtype.type(min(max(a + KEY_BYTES, int(end[0])), len(self.bytes))))
            y = int(np.searchsorted(self.at, self.at.dtype.type(word)))
            begin, end = self.spans(slice(x, y))
            of = every[a : end[-1]].astype(U)
            powers, back = powers_to(len(of))
            of += U(1)
            of *= powers[: len(of)]
            prefix = np.zeros(len(of) + 1, dtype=U)
            np.cumsum(of, out=prefix[1:])
            out[x:y] = (prefix[end - a] - prefix[begin - a]) * back[begin - a]
            x = y
        for k in range(0, len(out), WINDOWS_AT_ONCE):
            some = out[k : k + WINDOWS_AT_ONCE]
            some ^= some >> U(30)
            some *= U(MIX[0])
            some ^= some >> U(27)
            some *= U(MIX[1])
            some ^= some >> U(31)
        return out

    def digests(self, of: np.ndarray) -> np.ndarray:
        """The 128-bit digests of some windows' words, as two columns."""
        digest, own, out = xxhash.xxh3_128_digest, self.bytes, np.zeros((len(of), 2), dtype="<u8")
        for k in range(0, len(of), WINDOWS_AT_ONCE):
            begin, end = self.spans(of[k : k + WINDOWS_AT_ONCE])
            joined = b"".join([digest(own[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            out[k : k + WINDOWS_AT_ONCE] = np.frombuffer(joined, dtype="<u8").reshape(-1, 2)
        return out

    def without(self, starts: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """Each document's id, words, words that windows starting at these words cover, and the other words."""
        edges = np.zeros(len(self.starts), dtype=np.int32)
        edges[starts] += 1  # no two windows start or end at one word
        edges[starts + self.window] -= 1
        gone = np.cumsum(edges, out=edges)[:-1] > 0
        del edges
        last = np.cumsum(self.words)
        first = last - self.words
        for d, n, x, y, begin, end in zip(self.doc_ids, self.words.tolist(), first.tolist(), last.tolist(), self.starts[first].tolist(), self.starts[last].tolist(), strict=True):
            removed = int(np.count_nonzero(gone[x:y]))
            kept = self.bytes[begin : end - 1] if n else b""
            if removed:  # kept words come in runs
                turns = np.flatnonzero(np.diff(gone[x:y], prepend=True, append=True)) + x
                runs = self.starts[turns].tolist()
                kept = b" ".join([self.bytes[a : b - 1] for a, b in zip(runs[::2], runs[1::2], strict=True)])
            yield d, n, removed, kept


_POWERS: list[np.ndarray] = []


def powers_to(n: int) -> list[np.ndarray]:
    """BASE to the powers 0 to n at least, and its inverse; kept by the process but for very long windows."""
    if _POWERS and n < len(_POWERS[0]):
        return _POWERS
    size = max(n, 2 * KEY_BYTES) + 1
    made = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(size, U(x), dtype=U)
        powers[0] = 1
        made.append(np.cumprod(powers, out=powers))
    if n <= 2 * KEY_BYTES:
        _POWERS[:] = made
    return made


def positions(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Where a count-min row counts each window."""
    mixed = (keys ^ (keys >> U(29))) * U(MIX[0]) if row else keys
    return mixed >> U(64 - bits)


def sorted_counts(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different positions, sorted, and whether each was met more than once."""
    found = np.sort(found)
    new = np.ones(len(found) + 1, dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:-1])
    return found[new[:-1]], ~new[1:][new[:-1]]


def shard_bounds(found: np.ndarray, shift: int, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted values starts, and where the last one ends."""
    first = np.arange(shards, dtype=U) << U(shift) if shift < 64 else np.zeros(1, dtype=U)
    return np.append(np.searchsorted(found, first), len(found))


def pack_bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unpack_bits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).astype(bool)


def sketch(block: Block, row: int, bits: int, shift: int) -> Iterator[tuple[int, bytes]]:
    """(shard, sorted positions within it, as gaps with a bit for "more than once")."""
    found, twice = sorted_counts(positions(block.keys(), row, bits))
    bounds = shard_bounds(found, shift, 1 << (bits - shift))
    for shard in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[shard], bounds[shard + 1]
        low = (found[a:b] & U((1 << shift) - 1)).astype(np.int64)
        gaps = np.diff(low, prepend=0) * 2 + twice[a:b]
        yield shard, (b"2" + gaps.astype("<u2").tobytes() if gaps.max() < 1 << 16 else b"4" + gaps.astype("<u4").tobytes())


def merge_sketches(data: list[bytes], shift: int) -> list[bytes]:
    """All blocks' parts of a shard of a count-min row -> each block's answer."""
    counts = np.zeros(1 << shift, dtype=np.uint8)
    at = []
    for x in data:
        gaps = np.frombuffer(x, dtype="<u2" if x[:1] == b"2" else "<u4", offset=1).astype(np.int64)
        at.append(np.cumsum(gaps >> 1))
        counts[at[-1]] = np.minimum(counts[at[-1]] + 1 + (gaps & 1).astype(np.uint8), 2)
    return [pack_bits(counts[p] > 1) for p in at]


def estimated(block: Block, answers: dict[tuple[int, int], bytes], bits: int, shift: int) -> np.ndarray:
    """Which windows both rows' merged sketches estimate as repeated."""
    keys, out = block.keys(), np.ones(len(block.at), dtype=bool)
    for row in range(ROWS):
        different = sorted_counts(positions(keys, row, bits))[0]
        bounds = shard_bounds(different, shift, 1 << (bits - shift))
        again = [different[bounds[s] : bounds[s + 1]][unpack_bits(answers[row, s], int(bounds[s + 1] - bounds[s]))] for s in np.flatnonzero(np.diff(bounds)).tolist()]
        again = np.concatenate(again) if again else np.zeros(0, dtype=U)
        del different
        if not len(again):
            out[:] = False
        for k in range(0, len(keys) if len(again) else 0, WINDOWS_AT_ONCE):
            found = positions(keys[k : k + WINDOWS_AT_ONCE], row, bits)
            near = np.minimum(np.searchsorted(again, found), len(again) - 1)
            out[k : k + WINDOWS_AT_ONCE] &= again[near] == found
    return np.flatnonzero(out)


def exact_groups(block: Block, some: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Estimated windows by digest: the different digests sorted, which are met twice here, each window's place among
    them, and the bounds of shards."""
    digests = block.digests(some) if len(some) else np.zeros((0, 2), dtype="<u8")
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    digests = digests[order]
    new = np.ones(len(digests) + 1, dtype=bool)
    np.any(digests[1:] != digests[:-1], axis=1, out=new[1:-1])
    place = np.zeros(len(some), dtype=block.at.dtype)
    place[order] = np.cumsum(new[:-1], dtype=place.dtype) - 1
    twice = ~new[1:][new[:-1]]
    different = digests[new[:-1]]
    shift = 64 - (shards.bit_length() - 1)
    return different, twice, place, shard_bounds(different[:, 0].copy(), shift, shards)


def merge_exact(data: list[bytes]) -> list[bytes]:
    parts = []
    for x in data:
        n = int.from_bytes(x[:4], "little")
        parts.append((np.frombuffer(x, dtype="<u8", offset=4, count=2 * n).reshape(-1, 2), unpack_bits(x[4 + 16 * n :], n)))
    every, count = np.concatenate([p for p, _ in parts]), np.concatenate([1 + t.astype(np.int64) for _, t in parts])
    order = np.lexsort((every[:, 1], every[:, 0]))
    ordered = every[order]
    group = np.cumsum(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])) - 1
    again = np.zeros(len(every), dtype=bool)
    again[order] = (np.bincount(group, weights=count[order]) > 1)[group]
    ends = np.cumsum([len(p) for p, _ in parts])
    return [pack_bits(again[e - len(p) : e]) for e, (p, _) in zip(ends, parts, strict=True)]


def lay_out(docs: DataFrame, doc_id: str, text: str, window: int, block_bytes: int) -> DataFrame:
    """block, payload, windows: the documents' words as blocks, bucketed by block in the shared folder."""
    spark = session_of(docs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "words": pa.array(texts, pa.large_binary())})
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            windows = sum(max(0, t.count(b" ") + 2 - window) for t in texts)
            row = [pa.array([(task << 32) + made], pa.int64()), pa.array([zlib.compress(sink.getvalue(), 1)], pa.binary()), pa.array([windows], pa.int64())]
            return pa.RecordBatch.from_arrays(row, names=["block", "payload", "windows"])

        for batch in batches:
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").split())
                if held and held + len(words) > block_bytes:
                    yield block()
                    made, ids, texts, held = made + 1, [], [], 0
                ids.append(d)
                texts.append(words)
                held += len(words) + 1
        if ids:
            yield block()
        ids, texts = [], []
        give_back()

    laid = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(blocks, "block long, payload binary, windows long")
    name = f"substring_blocks_{uuid.uuid4().hex}"
    laid.write.bucketBy(2 * shuffle_parts(spark), "block").option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bits: int = SHARD_BITS) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    blocks = lay_out(docs, doc_id, text, window, block_bytes)
    windows = blocks.agg(F.sum("windows")).first()[0] or 0
    bits = max(12, (SPARSE * windows).bit_length())
    shift = min(shard_bits, bits)
    exact_shards = 1 << max(0, (windows >> (shard_bits - FINER)).bit_length())

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"], strict=True):
                own = Block(payload.as_py(), window)
                for row in range(ROWS):
                    found = list(sketch(own, row, bits, shift))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(found), pa.int32()), pa.array([s for s, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["row", "shard", "block", "data"]
                    )
                del own, found
                give_back()

    def merged(of: pd.DataFrame) -> pd.DataFrame:
        bits_of = merge_sketches(list(of["data"]), shift)
        give_back()
        return pd.DataFrame({"block": of["block"], "row": of["row"], "shard": of["shard"], "bits": bits_of})

    answer = "block long, row int, shard int, bits binary"
    shards = blocks.select("block", "payload").mapInArrow(sketches, "row int, shard int, block long, data binary").groupBy("row", "shard")
    answers = staged(shards.applyInPandas(merged, answer), "substring-sketch")

    def answers_of(of: pd.DataFrame) -> dict[tuple[int, int], bytes]:
        return {(r, s): x for r, s, x in zip(of["row"].tolist(), of["shard"].tolist(), of["bits"], strict=True)}

    def candidates(_: tuple, own: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for block, payload in zip(own["block"].tolist(), own["payload"], strict=True):
            here = Block(payload, window)
            different, twice, _, bounds = exact_groups(here, estimated(here, answers_of(of), bits, shift), exact_shards)
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = int(bounds[s]), int(bounds[s + 1])
                rows.append((s, block, (b - a).to_bytes(4, "little") + different[a:b].tobytes() + pack_bits(twice[a:b])))
            del here, different, twice
            give_back()
        return pd.DataFrame(rows, columns=["shard", "block", "data"])

    def merged_exact(of: pd.DataFrame) -> pd.DataFrame:
        bits_of = merge_exact(list(of["data"]))
        give_back()
        return pd.DataFrame({"block": of["block"], "row": -1, "shard": of["shard"], "bits": bits_of})

    def beside(given: DataFrame):
        return blocks.select("block", "payload").groupBy("block").cogroup(given.groupBy("block"))

    found = beside(answers).applyInPandas(candidates, "shard int, block long, data binary")
    confirmed = staged(found.groupBy("shard").applyInPandas(merged_exact, answer), "substring-exact")

    def removed(_: tuple, own: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        given, rows = answers_of(of), []
        for payload in own["payload"]:
            here = Block(payload, window)
            some = estimated(here, given, bits, shift)
            different, _, place, bounds = exact_groups(here, some, exact_shards)
            again = [unpack_bits(given[-1, s], int(bounds[s + 1] - bounds[s])) for s in np.flatnonzero(np.diff(bounds)).tolist()]
            starts = here.at[some[np.concatenate(again)[place]]] if again else np.zeros(0, dtype=np.int64)
            del some, different, place, again
            rows += [(d, n, gone, kept.decode("utf-8", "surrogatepass")) for d, n, gone, kept in here.without(starts)]
            del here, starts
            give_back()
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])

    return beside(answers.unionByName(confirmed)).applyInPandas(removed, "doc_id long, n_words long, n_removed long, kept string")
