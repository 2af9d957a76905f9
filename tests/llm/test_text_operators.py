"""Packing, substring dedup, secrets, SimHash and mixing against brute force."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from palimpsest.llm import mixing, packing, secrets, simhash, substring
from palimpsest.llm.queries import queries

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module", params=["docs", "odd", "empty"])
def given(request):
    df = request.getfixturevalue(request.param)
    return df, [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_packing_is_whole_gapless_and_near_the_bound(given):
    from tokenizers import Tokenizer

    df, docs = given
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d, t, _ in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, k in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[k : k + 2048], dtype="<u4")
            want[d, piece, k, len(own), zlib.crc32(own.tobytes())] += 1
    got = rows(packing.pack(df))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= 1.02 * total / 2048 + 2


def test_other_tokenizer_files_encode_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from palimpsest.llm.tokens import word_tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), ["A b,  c.\nD", None, "", "Éa 12 <|endoftext|> x"]
    ids, ends = word_tokenizer(path).ids(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 0]


def test_ids_of_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from palimpsest.llm.tokens import chunks, word_tokenizer

    odd = ["", None, "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "it's We'll 'tis ÀÉİ naïve é\tb\x1cc d\x85 日本語 Ⅷ² ½\r\n x\x00y ﬁ Σας", "l'eau d'où" * 3, "e\u0301" * 10, "\ufeffabc '", "x" * 3000, "End. Next, one.. two ,. three!, four"]
    plain, whole = word_tokenizer(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for texts in (odd, [t for t in odd if t and "<|" not in t]):
        ids, ends = plain.ids(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 0]
    assert list(chunks(pa.array(["ab", None, "c" * 9, ""]), 3)) == [(0, 2), (2, 3), (3, 4)]


def test_runs_hold_every_piece_once():
    rng = np.random.default_rng(7)
    for lengths in (rng.integers(1, 2049, 3000), rng.integers(600, 900, 999), rng.integers(1, 9, 500), np.full(77, 2048), np.full(5, 683)):
        histogram = dict(Counter(lengths.tolist()))
        for scheme in packing.SCHEMES:
            placed, used = Counter(), Counter()
            for length, first, n, sequence, _ in packing.plan_runs(histogram, 2048, *scheme):
                assert first == placed[length]
                placed[length] += n
                used.update({sequence + k: length for k in range(n)})
            assert placed == Counter(histogram)
            assert max(used.values()) <= 2048


def brute_repeats(docs, window):
    words = [(d, (t or "").encode().split()) for d, t, _ in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), kept.decode()))
    return Counter(out)


@pytest.mark.parametrize("block", [6_000_000, 3000])
def test_repeated_windows_go(given, block):
    df, docs = given
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows(substring.remove_repeats(df, block_bytes=block, shard_bits=14)))
    assert got == brute_repeats(docs, 35)


def block_of(texts):
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "words": pa.array([t.encode() for t in texts], pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zlib.compress(sink.getvalue(), 1)


@pytest.mark.parametrize("copies", [1, 2, 2000])
def test_a_block_of_repeats_takes_bounded_memory(copies):
    """One long text, two, and many, with all windows estimated as repeated: bytes held at once, for each byte of text."""
    rng = np.random.default_rng(5)
    text = " ".join(f"w{k}" for k in rng.integers(0, 90_000, 600_000 // copies).tolist())
    payload, size = block_of([text] * copies), (len(text) + 1) * copies
    tracemalloc.start()
    try:
        block = substring.Block(payload, 35)
        answers = {}
        for row in range(substring.ROWS):
            for shard, data in substring.sketch(block, row, 24, 16):
                answers[row, shard] = substring.pack_bits(np.ones(len(data) // 2, dtype=bool))
        some = substring.estimated(block, answers, 24, 16)
        assert len(some) == len(block.at)
        different, twice, place, _ = substring.exact_groups(block, some, 256)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(different) == len(some) // copies and twice.all() == (copies > 1) and place.max() == len(different) - 1
    assert peak < 20 * size


def test_slices_of_a_block_give_what_the_whole_gives(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["", "a " * 90 + "a", "", " ".join(f"w{k}" for k in rng.integers(0, 9, 500).tolist()), "x" * 900, " ".join("y" * k for k in range(1, 90)), "é 日本 " * 40 + "z", ""]
    block = substring.Block(block_of(texts), 35)
    words = [t.encode().split() for t in texts]
    windows = [b" ".join(w[k : k + 35]) for w in words for k in range(len(w) - 34)]
    keys, digests = block.keys(), block.digests(np.arange(len(block.at)))
    assert len(set(zip(windows, keys.tolist(), strict=True))) == len(set(windows)) == len(set(keys.tolist()))
    assert digests.tobytes() == b"".join(xxhash.xxh3_128_digest(w) for w in windows)
    for key_bytes, at_once in ((1, 1), (100, 7), (3000, 64)):
        monkeypatch.setattr(substring, "KEY_BYTES", key_bytes)
        monkeypatch.setattr(substring, "WINDOWS_AT_ONCE", at_once)
        monkeypatch.setattr(substring, "_POWERS", [])
        assert (block.keys() == keys).all() and (block.digests(np.arange(len(block.at))) == digests).all()
    some = block.at[rng.random(len(block.at)) < 0.02]
    gone = np.zeros(sum(map(len, words)), dtype=bool)
    for k in some.tolist():
        gone[k : k + 35] = True
    parts = np.split(gone, np.cumsum([len(w) for w in words]))
    assert list(block.without(some)) == [(d, len(w), int(g.sum()), b" ".join(x for x, y in zip(w, g.tolist(), strict=True) if not y)) for d, (w, g) in enumerate(zip(words, parts[:-1], strict=True))]


BASE = [
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx, g, n) in enumerate(BASE) for m in rx.finditer(text or "") if len(m[g]) >= n]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_secrets(given):
    df, docs = given
    paths, _ = secrets.scan(df)
    got = Counter((r["path"], tuple(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in ("assign", "access", "hex"))) for r in rows(paths))
    assert got == Counter((d, tuple(base_spans(t))) for d, t, _ in docs)


def test_ledger_scans_only_unseen_pairs(spark, odd):
    paths, ledger = secrets.scan(odd)
    n = odd.select("text").distinct().count() - 1  # null and empty are one blob
    assert ledger.count() == n * len(secrets.RULES)
    again, new = secrets.scan(odd, ledger=ledger)
    assert new.count() == 0
    assert Counter(map(str, rows(again))) == Counter(map(str, rows(paths)))
    rules = (*secrets.RULES[:-1], secrets.Rule("pem", "no id", 3, version=2))
    _, new = secrets.scan(odd, rules=rules, ledger=ledger)
    assert {(r["rule"], r["version"]) for r in rows(new)} == {("pem", 2)}


def test_redaction_covers_overlaps(spark):
    df = spark.createDataFrame([("ab token=0123456789abcdef0 z", [(3, 0, 26, "assign"), (9, 2, 26, "hex")])], f"text string, spans array<{secrets.SPAN}>")
    from pyspark.sql import functions as F

    assert df.select(secrets.redacted(F.col("text"), F.col("spans"))).first()[0] == "ab [SECRET] z"


def test_very_many_hits_in_one_text(spark):
    """More hits than one step's list holds, and spans across the pieces that a long text is redacted in."""
    hits = [f"é token=secret{k:06d}abcdef" for k in range(20000)]
    text = " ".join(hits)
    df = spark.createDataFrame([(1, text, 5), (2, "x" * 4090 + " token=abcdefghijklmnop " + "y" * 5000, 6)], "doc_id long, text string, at int")
    paths, _ = secrets.scan(df)
    got = {r["path"]: r["spans"] for r in paths.collect()}
    assert [(x["start"], x["end"], x["kind"]) for x in got[1] if x["kind"] == "assign"] == [(m.start(), m.end(), "assign") for m in re.finditer(r"token=\w+", text)]
    from pyspark.sql import functions as F

    told = {r[0]: r[1] for r in df.join(paths.select("path", "spans"), F.col("doc_id") == F.col("path")).select("doc_id", secrets.redacted(F.col("text"), F.col("spans"))).collect()}
    assert told[1] == " ".join("é [SECRET]" for _ in hits)
    assert told[2] == "x" * 4090 + " [SECRET] " + "y" * 5000


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(given):
    df, docs = given
    fps = [(d, brute_fingerprint(t)) for d, t, _ in docs]
    parent = {f: f for _, f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    different = sorted(parent)
    for i, a in enumerate(different):
        for b in different[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(df)))
    assert got == Counter((d, f"{f:016x}", least.get(root(f))) for d, f in fps)
    kept = rows(simhash.keep_one(df))
    assert Counter(r["doc_id"] for r in kept) == Counter(least.get(f) for f in {root(f) for _, f in fps})
    assert not kept or set(kept[0]) == set(df.columns)


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    words = [" ".join(f"{w}{k}" for k in range(40)) for w in "abc"]
    given = [(1, words[0], 5), (1, words[1], 6), (None, words[2], 7), (None, words[2], 7), (3, words[0], 8)]
    df = spark.createDataFrame(given, "doc_id long, text string, _row int")
    assert sorted(map(str, rows(simhash.keep_one(df)))) == sorted(str(dict(zip(df.columns, g, strict=True))) for g in given[:3])


def test_components_of_a_long_chain(spark):
    """Labels reach over a chain in a number of rounds that grows with its length's logarithm."""
    n = 200
    edges = spark.range(n - 1).selectExpr("id * 79 % 211 AS a", "(id + 1) * 79 % 211 AS b")
    got = rows(simhash.components(edges))
    assert len(got) == n and len({r["root"] for r in got}) == 1


def test_crowded_cells_keep_their_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 18, 300).astype(np.uint64) << np.uint64(23)
    flips = [np.bitwise_or.reduce(np.left_shift(np.uint64(1), rng.integers(0, 64, (k, 300)).astype(np.uint64))) for k in (1, 2, 4)]
    own = np.unique(np.concatenate([base, *[base ^ f for f in flips]])).view(np.int64)

    def classes(edges):
        parent = {f: f for f in own.tolist()}
        for a, b in edges:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = {}
        for f in own.tolist():
            r = f
            while parent[r] != r:
                r = parent[r]
            out[f] = r
        return out

    assert classes(simhash.cell_trees(own, crowded=64)) == classes(simhash.cell_trees(own, crowded=len(own)))


def test_cells_meet_whatever_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.bitwise_or.reduce(np.left_shift(np.uint64(1), rng.integers(0, 64, (n, 200)).astype(np.uint64))) for n in (1, 2, 3, 4)]]))
    cell, own = simhash.cells(fps.view(np.int64))
    meets = defaultdict(set)
    for c, f in zip(cell.tolist(), own.view(np.uint64).tolist(), strict=True):
        meets[f].add(c)
    for a in fps.tolist():
        for b in fps.tolist():
            if a < b and (a ^ b).bit_count() <= 4:
                assert meets[a] & meets[b]


def test_mixture_reaches_its_targets(given):
    df, docs = given
    sized = [(d, len(WORD.findall(t or "")), s) for d, t, s in docs]
    source_size = Counter()
    for _, n, s in sized:
        source_size[s] += n
    order = sorted((s for s in source_size if s is not None)) + [s for s in source_size if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(source_size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * source_size[s]}
        if not over:
            target.update({s: weight[s] * level for s in open_})
            break
        target.update({s: 2.0 * source_size[s] for s in over})
        left -= sum(target[s] for s in over)
        open_ -= over
    got = rows(mixing.mix(df, block_words=64))
    by = {d: s for d, _, s in sized}
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((d, n, source_size[s]) for d, n, s in sized)
    taken = Counter()
    for r in got:
        s = by[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    assert Counter(map(str, rows(mixing.mix(df.repartition(2), block_words=64)))) == Counter(map(str, got))


def test_schedule_keeps_weights_in_every_stretch(spark):
    targets = spark.createDataFrame([("=a", "a", 0, 900.0), ("=b", "b", 1, 300.0), ("=c", "c", 2, 607.0)], "source_key string, source string, place int, target double")
    slots = sorted(rows(mixing.schedule(targets, 10)), key=lambda r: r["slot"])
    assert Counter(r["source_key"] for r in slots) == {"=a": 90, "=b": 30, "=c": 61}
    assert sum(r["words"] for r in slots) == 1807
    for stop in (20, 60, 120):
        got = Counter(r["source_key"] for r in slots[:stop])
        assert abs(got["=a"] - stop * 90 / 181) < 6
    assert [r["rank"] for r in slots if r["source_key"] == "=a"] == list(range(90))


def test_mix_follows_the_schedule(given):
    """Every slot of the schedule holds one block of its source, gapless and in the stream's order."""
    df, docs = given
    words = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    got = rows(mixing.mix(df, block_words=64))
    held = defaultdict(list)
    for r in got:
        assert r["taken"] == sum(p["words"] for p in r["pieces"]) == sum(r["passes"])
        for n, whole in enumerate(r["passes"]):  # first words of the document, in each pass
            at = 0
            for p in r["pieces"]:
                if p["pass"] == n:
                    assert p["first"] == at
                    at += p["words"]
            assert at == whole <= words[r["doc_id"]]
        for p in r["pieces"]:
            held[r["source_key"], p["rank"], p["slot"]].append((p["place"], p["words"]))
    last, sources = {}, Counter()
    for key, rank, _ in held:
        last[key] = max(rank, last.get(key, 0))
        sources[key] += 1
    assert all(sources[k] == last[k] + 1 for k in last)
    for (key, rank, _), found in held.items():
        at = 0
        for place, n in sorted(found):
            assert place == at
            at += n
        assert at == 64 or rank == last[key]
    slots = sorted((slot, key, rank) for key, rank, slot in held)
    for key in last:
        assert [rank for _, k, rank in slots if k == key] == list(range(last[key] + 1))
    shares, half = {k: n / len(slots) for k, n in sources.items()}, slots[: len(slots) // 2]
    for key, share in shares.items():
        assert abs(sum(k == key for _, k, _ in half) - share * len(half)) <= 8


def test_first_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  a b\n\tc ", 2), ("a", 1), ("a b ", 2)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a b", "a", "a b"]


@pytest.mark.parametrize("name,columns", [("op1_pack", "doc_id piece start length ids_crc32 sequence_id offset"), ("op2_substring", "doc_id n_words n_removed kept_sha256"), ("op6_secrets", "doc_id n_assign n_access n_hex base_sha256 spans"), ("op7_simhash", "doc_id fingerprint component_id"), ("op10_mix", "doc_id size source_size target taken")])
def test_queries_return_their_columns(spark, name, columns):
    df = queries()[name](spark, SF)
    assert df.columns[: len(columns.split())] == columns.split()
    if name == "op2_substring":
        empty = hashlib.sha256(b"").hexdigest()
        assert all(r["kept_sha256"] == empty for r in rows(df) if r["n_words"] == r["n_removed"])


@pytest.mark.parametrize("doc_id", ["cast(null AS long)", "cast(3 AS long)"])
def test_the_mix_does_not_depend_on_where_rows_lie(spark, doc_id):
    """Rows without ids, or with one, that have as many words each: two partitionings give one mix."""
    given = spark.range(300).selectExpr(f"{doc_id} AS doc_id", "concat('w', id, ' and other ', id % 7, repeat(' more', id % 2)) AS text", "concat('s', id % 3) AS source", "id AS own")
    told = lambda df: Counter((r["carried"]["own"], r["taken"], tuple(map(tuple, r["pieces"]))) for r in mixing.mix(df, carry=("text", "own"), block_words=16).collect())
    assert told(given.repartition(2)) == told(given.repartition(7, "own"))
