"""How the sources of a language differ in the words they use: a sort-based, streaming audit.

Pass 1. Tasks count terms of whole texts and send, for each (lang, term, source) and some consecutive documents, one run:
document frequency and count (so a frequent word is one row a source and stretch of documents, not one an occurrence).
Runs are repartitioned by (lang, term) and sorted by (lang, term, source, document); a scan adds up equal neighbours,
keeps the terms that are in enough documents, and emits a row a term and source. It holds one term at a time.

Pass 2. Kept rows get exact shares p in billionths. They are sorted by term within (lang, tile, tile, slice), where a tile
is TILE sources of the language and a slice a hash of the term; rows that tell the tiles' sources come first. A scan keeps
two tiles' matrix and adds up, over the terms it comes across, how far each pair's difference departs from that of two
sources without the term; it emits a partial sum a pair and slice. Pairs are summed, ranked and written in both directions.

Sums are whole numbers: shares are divided in 38-digit decimals, differences of shares add up to less than 2^32 a pair.

Nulls and odd cases: null text, lang and source are ''; every row is a document of its own, whatever its id, repeated
rows too; a group without terms still has a row for every other source; V = 0 gives 0 to every pair and no terms; an empty
table gives no rows; other columns are not read. Texts of any length are read in stretches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, session_of, shuffle_parts, staged

LEAST_DOCUMENTS = 30
BILLION = 1_000_000_000
ADDED = 5
TERMS_SHOWN = 50
#: Sources side by side in a scan's matrix.
TILE = 512
#: Bytes of a text that are cut into terms at once.
STRETCH = 1 << 22
#: Terms a task holds before it sends its runs.
HELD = 200_000
#: Entries of the matrix of terms and sources that a scan fills at once.
CELLS = 1 << 21

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; a term is never cut."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            piece = text[at:end].translate(LETTERS)
            if (cut := piece.rfind(b" ")) < 0:  # a term longer than a stretch
                while end < len(text) and LETTERS[text[end]] != 32:
                    end += 1
                piece = text[at:end].translate(LETTERS)
            else:
                piece, end = piece[:cut], at + max(1, cut)
        else:
            piece = text[at:].translate(LETTERS)
        yield piece.split()
        at = end


def runs(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, source, document, df, n: counts of stretches of consecutive documents; document is the first one's place."""
    given = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.monotonically_increasing_id().alias("document"))
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("document", pa.int64()), ("df", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[int, Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (of, own), (first, n, df) in sorted(groups.items()):
                terms = list(n)
                for low in range(0, len(terms), 50_000):
                    some = terms[low : low + 50_000]
                    same = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(len(some), dtype=np.int32)))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(of, pa.string()), pa.array(some, pa.binary()), same(own, pa.string()), same(first, pa.int64()), pa.array([df[t] for t in some], pa.int64()), pa.array([n[t] for t in some], pa.int64())], schema=schema)
            groups.clear()

        for batch in batches:
            for cell, of, own, document in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                body = cell.as_py()
                first, n, df = groups.setdefault((of, own), (document, Counter(), Counter()))
                if len(body) <= STRETCH:
                    terms = body.translate(LETTERS).split()
                    n.update(terms)
                    df.update(set(terms))
                else:
                    seen: set[bytes] = set()
                    for terms in stretches(body):
                        n.update(terms)
                        seen.update(terms)
                    df.update(seen)
            if sum(len(n) for _, n, _ in groups.values()) > HELD:
                yield from told()
        yield from told()
        give_back()

    return given.mapInArrow(count, "lang string, term binary, source string, document long, df long, n long").withColumn("term", F.col("term").cast("string"))


def changes(*columns: pa.Array) -> np.ndarray:
    """True where a row differs from the one before; the first row does."""
    rows = len(columns[0])
    new = np.zeros(rows, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    return new


def kept_terms(sorted_runs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, n, n_lang: of every term in at least `least` documents of its language, a row a source that has
    it. sorted_runs must hold a term's rows in one partition, sorted."""
    given = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("df", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("n_lang", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
            """Runs of (lang, term, source) added up, and where each term starts."""
            lang, term, source = (table.column(k).combine_chunks() for k in range(3))
            key = changes(lang, term)
            starts = np.flatnonzero(key | changes(source))
            add = lambda k: pa.array(np.add.reduceat(table.column(k).to_numpy(), starts))
            at = pa.array(starts)
            return pa.table([lang.take(at), term.take(at), source.take(at), add(3), add(4)], schema=given), np.flatnonzero(key[starts])

        def told(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            df, n = table.column(3).to_numpy(), table.column(4).to_numpy()
            lengths = np.diff(np.append(starts, len(df)))
            keep = np.repeat(np.add.reduceat(df, starts) >= least, lengths)
            whole = np.repeat(np.add.reduceat(n, starts), lengths)
            out = pa.table([*table.columns[:3], table.column(4), pa.array(whole)], schema=schema).filter(pa.array(keep))
            return out.combine_chunks()

        open_ = given.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            table, starts = summed(pa.concat_tables([open_, pa.Table.from_batches([batch]).select(given.names).cast(given)]))
            last = int(starts[-1])
            open_ = table.slice(last)
            if last:
                yield from told(table.slice(0, last), starts[:-1]).to_batches()
        if open_.num_rows:
            yield from told(open_, np.zeros(1, dtype=np.int64)).to_batches()
        give_back()

    return sorted_runs.select(*given.names).mapInArrow(scan, "lang string, term string, source string, n long, n_lang long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * terms)), exactly; null if there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = (wide(n) + F.lit(ADDED)) * F.lit(BILLION), wide(total) + F.lit(ADDED) * wide(terms)
    return F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(20,0)"))) + 1


def tile_pairs(tile: Column, tiles: Column) -> Column:
    """All pairs (low, high) of tiles that hold this one."""
    return F.transform(F.sequence(F.lit(0), tiles - 1), lambda k: F.struct(F.least(k, tile).alias("low"), F.greatest(k, tile).alias("high")))


def partial_pairs(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """lang, i, j, part: partial sums of pairs of a language's sources by place.

    rows, sorted by (lang, low, high, slice, kind, term): kind 0 tells a source's place and its share p of a term that it
    doesn't have, and V; kind 1 its share of a term.
    """
    schema = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, acc, terms = None, None, None, 0

        def sides() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of the tiles' sources in base, and where the first and the second sources of pairs are among them."""
            places = np.flatnonzero(base >= 0)
            low = int((places < tile).sum())
            return places, np.arange(low), np.arange(low) if key[1] == key[2] else np.arange(low, len(places))

        def told() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            places, left, right = sides()
            sums = np.zeros((len(left), len(right)), dtype=np.int64) if acc is None else acc
            a, b = places[left], places[right]
            if key[3] == 0:
                sums = sums + terms * np.abs(base[a][:, None] - base[b][None, :])
            i, j = np.meshgrid(key[1] * tile + a, key[2] * tile + b % tile, indexing="ij")
            take = (i < j) & ((sums != 0) | (key[3] == 0))
            if take.any():
                k = int(take.sum())
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * k, pa.string()), pa.array(i[take], pa.int32()), pa.array(j[take], pa.int32()), pa.array(sums[take], pa.int64())], schema=schema)

        def add(of: np.ndarray, place: np.ndarray, p: np.ndarray) -> None:
            """Terms of a key: of numbers them from 0; place is the source's in base."""
            nonlocal acc
            places, left, right = sides()
            acc = np.zeros((len(left), len(right)), dtype=np.int64) if acc is None else acc
            without, column = base[places], np.searchsorted(places, place)
            step = max(1, CELLS // len(places))
            for low in range(0, int(of[-1]) + 1, step):
                a, b = np.searchsorted(of, [low, low + step])
                matrix = np.repeat(without[None, :], int(of[b - 1]) - low + 1, axis=0)
                matrix[of[a:b] - low, column[a:b]] = p[a:b]
                other, plain = matrix[:, right], without[right]
                for x in left.tolist():
                    acc[x] += np.abs(matrix[:, [x]] - other).sum(axis=0) - len(matrix) * np.abs(without[x] - plain)

        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            column = {n: table.column(n).combine_chunks() for n in table.column_names}
            wholes = {n: column[n].to_numpy() for n in ("low", "high", "slice", "kind", "place", "p", "terms")}
            new = changes(*(column[n] for n in ("lang", "low", "high", "slice")))
            starts = np.append(np.flatnonzero(new), len(new))
            carry = None
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                now = (column["lang"][a].as_py(), int(wholes["low"][a]), int(wholes["high"][a]), int(wholes["slice"][a]))
                if now != key:
                    yield from told()
                    key, base, acc = now, np.full(2 * tile, -1, dtype=np.int64), None
                second = (wholes["place"][a:b] // tile != key[1]).astype(np.int64)
                place = wholes["place"][a:b] % tile + second * tile
                head = wholes["kind"][a:b] == 0
                base[place[head]] = wholes["p"][a:b][head]
                terms = int(wholes["terms"][a]) if head.any() else terms
                of = np.cumsum(changes(column["term"].slice(a, b - a))) - 1
                if b == len(new) and not head[-1]:  # the last term may go on in the next batch
                    last = int(np.searchsorted(of, of[-1]))
                    last = max(last, int(head.sum()))
                    carry = table.slice(a + last)
                    of, place, head = of[:last], place[:last], head[:last]
                    end = a + last
                else:
                    end = b
                body = ~head
                if body.any():
                    numbers = of[body] - of[body][0]
                    add(numbers, place[body], wholes["p"][a:end][body])
        if carry is not None:
            column = {n: carry.column(n).combine_chunks() for n in carry.column_names}
            place = column["place"].to_numpy()
            add(np.zeros(len(place), dtype=np.int64), place % tile + (place // tile != key[1]) * tile, column["p"].to_numpy())
        yield from told()
        give_back()

    return rows.select("lang", "low", "high", "slice", "kind", "term", "place", "p", "terms").mapInArrow(scan, "lang string, i int, j int, part long")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, shown: int = TERMS_SHOWN, text: str = "text", lang: str = "lang", source: str = "source", tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, summed over the
    language's kept terms (part pair), and its terms that most exceed the language's share of them (part term)."""
    parts = shuffle_parts(session_of(docs))
    order = ["lang", "term", "source", "document"]
    kept = staged(kept_terms(runs(docs, text, lang, source).repartition(parts, "lang", "term").sortWithinPartitions(*order), least), "divergence-terms")

    there = docs.groupBy(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("documents"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of = kept.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total_lang"))
    groups = there.join(own, ["lang", "source"], "left").join(of, "lang", "left")
    of_lang = Window.partitionBy("lang")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "total_lang")], (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"), F.count("*").over(of_lang).alias("sources"))
    groups = groups.withColumn("without", F.coalesce(share(zero, F.col("total"), F.col("terms")), zero))
    groups = staged(groups, "divergence-groups")

    told = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    over = told.withColumn("value", F.col("p") - share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))).where("value > 0")
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", rank()).where(F.col("rank") <= shown)

    at = F.floor(F.col("place") / tile).cast("int")
    tiles = F.ceil(F.col("sources") / tile).cast("int")
    pair = F.explode(tile_pairs(at, tiles)).alias("pair")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slice")
    heads = groups.where("sources > 1").select("lang", "place", F.col("without").alias("p"), "terms", pair).select("*", every, F.lit(0).alias("kind"), F.lit("").alias("term"))
    body = told.where("sources > 1").select("lang", "place", "p", "terms", pair, F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("slice"), F.lit(1).alias("kind"), "term")
    rows = heads.unionByName(body).select("lang", "pair.low", "pair.high", "slice", "kind", "term", "place", "p", "terms")
    key = ["lang", "low", "high", "slice"]
    sums = partial_pairs(rows.repartition(parts, *key).sortWithinPartitions(*key, "kind", "term"), tile).groupBy("lang", "i", "j").agg(F.sum("part").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("pair"))
    both = both.select("lang", "value", "pair.a", "pair.b")
    named = lambda place, name: groups.select("lang", F.col("place").alias(place), F.col("source").alias(name))
    pairs = both.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank())
    return pairs.unionByName(over)
