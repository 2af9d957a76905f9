"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream: its documents, shuffled by a seeded hash, laid end to end, and cut into blocks of equally many
words. The van der Corput sequence deals slots to sources: slot i belongs to the source whose share of [0, 1) holds the
bit-reversed i. The r-th slot of a source takes the r-th block of its stream, and the stream starts again at its end; so
any stretch of the schedule holds the sources close to their weights, and the mix is the same on every run. Blocks are
joined to slots by source and rank; what a document has in them are its pieces, and what is taken of it is their sum.
The mix in order is all pieces by slot, source, rank and place in the block.

Nulls and odd cases: a null text has no words and is never taken; a null source is a source of its own, the last in
order; repeated rows are documents of their own; an empty table gives an empty mix. No extra column of the input is
read, unless `carry` names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, hash_bucket, power_of_two, session_of, shuffle_parts, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 512
#: Van der Corput points are whole numbers of so many bits; that many slots are different points.
POINT_BITS = 40
#: The schedule is ranked in so many stretches for each shuffle partition.
STRETCHES = 4
CELLS = 1024
#: Buckets of a stream for each shuffle partition: a document looks at all blocks of its bucket, so they are kept few.
BUCKETS = 128
SEED = 42


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sized (source_key, source, size) -> a row per source: source_size, weight, target.

    Targets share `share` of all words by weight; none passes `cap` times its source's size, and what would is shared
    again among the others. The driver sees two sums a round, never the sources.
    """
    sources = sized.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = staged(
        sources.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")), "mix-sources"
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped, most = 0.0, -1, F.col("source_size") * cap
    while True:
        over = F.col("weight") * level >= most
        full, rest, n = sources.agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))
        ).first()
        if n == capped or not rest:
            break
        level, capped = (share * total - full) / rest, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), most.cast("double")))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """targets -> a row per slot of the mix: slot, source_key, rank (the block of the source's repeated stream), words.

    A source takes as many blocks as its target needs, the last one cut short; slots that the sequence deals it beyond
    that are void, and blocks that it deals too few follow at the end.
    """
    spark = session_of(targets)
    order = Window.orderBy("place")
    need = F.ceil(F.col("words") / block_words).cast("long")
    asked = targets.withColumn("words", F.floor(F.col("target") + 0.5).cast("long")).withColumn("need", need)
    whole = asked.agg(F.sum("need")).first()[0] or 0
    stretch = max(64, -(-whole // (STRETCHES * shuffle_parts(spark))))
    points = 1 << POINT_BITS
    ends = F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0))
    asked = asked.withColumn("high", F.floor(ends / F.lit(max(1, whole)) * points).cast("long"))
    asked = asked.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0)))
    wide = points // CELLS
    held = asked.where("high > low").select(
        "source_key", "low", "high", "need", "words", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide))).alias("cell")
    )
    slots = spark.range(whole).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", F.conv(F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0")), 2, 10).cast("long"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / wide))
    dealt = slots.join(held, "cell").where("point >= low and point < high").select("slot", "source_key", "need", "words", F.floor(F.col("slot") / stretch).alias("chunk"))
    counts = dealt.groupBy("source_key", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source_key", "chunk").orderBy("slot")) - 1
    ranked = dealt.join(counts, ["source_key", "chunk"]).withColumn("rank", rank.cast("long")).where("rank < need")
    had = ranked.groupBy("source_key").agg(F.count("*").alias("had"))
    missing = asked.join(had, "source_key", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    late = missing.select(
        F.lit(whole).alias("slot"), "source_key", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"), "words"
    )
    cut = F.least(F.lit(block_words), F.col("words") - F.col("rank") * block_words).cast("long")
    return ranked.select("slot", "source_key", "rank", "words").unionByName(late).withColumn("words", cut)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken; its pieces, an array of (slot, rank, place in the
    block, pass over the source's stream, first word, words) in the stream's order; the words taken in each pass
    (`passes`, the document's first words each time); source_key, and the carried columns, as struct `carried`.
    """
    spark = session_of(docs)
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))
    bits = power_of_two(BUCKETS * shuffle_parts(spark))
    carried = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")])
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("source_key"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text), carried).alias("mark"), carried.alias("carried")
    )
    sized = base if carry else staged(base, "mix-sizes")
    sized = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "mark")).withColumn("bucket", hash_bucket(F.col("h"), bits))
    narrow = staged(sized.select("source_key", "source", "size", "bucket").groupBy("source_key", "bucket").agg(F.max("source").alias("source"), F.sum("size").alias("size")), "mix-buckets")
    targets = staged(source_targets(narrow, weights, share, cap), "mix-targets")
    slots = schedule(targets, block_words)
    start = F.sum("size").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = narrow.select("source_key", "bucket", F.col("size").alias("wide"), F.coalesce(start, F.lit(0)).alias("start"))
    starts = staged(starts.join(targets.select("source_key", "source_size", "target"), "source_key"), "mix-starts")
    # the blocks of the stream that a bucket has words in, each with its slot
    again = starts.where("wide > 0").select("source_key", "bucket", "wide", F.explode(F.array(*[F.struct(F.lit(n).alias("pass"), (F.col("start") + n * F.col("source_size")).alias("low")) for n in range(cap)])).alias("x"), "target")
    again = again.select("source_key", "bucket", F.col("x.pass").alias("pass"), F.col("x.low").alias("low"), (F.col("x.low") + F.col("wide")).alias("high"), "target").where("low < target + 1")
    ranks = F.sequence(F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words))
    blocks = again.select("source_key", "bucket", "pass", F.explode(ranks).alias("rank")).join(slots, ["source_key", "rank"])
    dealt = blocks.groupBy("source_key", "bucket").agg(F.sort_array(F.collect_list(F.struct("rank", "pass", "slot", "words"))).alias("dealt"))
    starts = staged(starts.join(dealt, ["source_key", "bucket"], "left").drop("wide"), "mix-dealt")
    within = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts.hint("merge"), ["source_key", "bucket"])
    placed = placed.withColumn("start", F.col("start") + F.col("before"))

    def piece(x: Column) -> Column:
        own, block = F.col("start") + x["pass"] * F.col("source_size"), x["rank"] * block_words
        low = F.greatest(own, block)
        words = F.least(own + F.col("size"), block + x["words"]) - low
        return F.struct(x["slot"].alias("slot"), x["rank"].alias("rank"), (low - block).alias("place"), x["pass"].alias("pass"), (low - own).alias("first"), words.alias("words"))

    some = F.filter(F.transform(F.coalesce("dealt", F.array()), piece), lambda x: x["words"] > 0)
    placed = placed.withColumn("pieces", some)
    total = lambda pieces: F.aggregate(pieces, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    within_pass = lambda n: F.filter("pieces", lambda x: x["pass"] == n)
    passes = F.array(*[total(within_pass(n)) for n in range(cap)])
    return placed.select("doc_id", "size", "source_size", "target", total(F.col("pieces")).alias("taken"), "pieces", passes.alias("passes"), "source_key", "carried")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space untouched."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, n.cast("int")), "")
