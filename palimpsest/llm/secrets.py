"""Secret scans by an incremental blob ledger, with DataFrame functions only.

Every version of every path is a blob, addressed by the SHA-256 of its text. A ledger holds (blob, rule, rule version)
pairs already scanned and what was found; a scan reads only the text of pairs that the ledger lacks, each blob once, and
joins findings back to every path that ever had the blob. A new rule, or a new version of one, rescans for that rule only.

Where a match starts is told by what lies before it: a regular expression's matches and the gaps that split() leaves
between them alternate, so running sums of their lengths are the spans, in code points.

Nulls and odd cases: a null text is the empty blob; repeated rows are paths of the same blob; an empty table gives an
empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import hot_safe_join, staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what a match is, which group of it must have `least` characters, and how the version is called."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


#: Fixed values. The first three are the base; the others add well-known key formats to them.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # the runs of [0-9a-f]+ that are long enough
)
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 20),
)
RULES = (*BASE, *ADDED)
#: Matches whose places are told at a time, and characters redacted at a time: bounds what is copied at each step.
STEPS = 256
PIECE = 4096
SPAN = "struct<start:int,place:int,end:int,kind:string>"


def spans(text: Column, rule: Rule, place: int) -> Column:
    """The rule's spans in the text, as array of (start, place, end, kind), leftmost first.

    Lists that grow step by step are copied at each; so matches are taken STEPS at a time, and their places moved after.
    """
    part = lambda m: F.regexp_extract(m, rf"^(?:{rule.pattern})$", rule.group) if rule.group else m
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, rule.pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.coalesce(x["gap"], F.lit(0))
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        own = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = x["m"].isNotNull() & (F.length(part(x["m"])) >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(done["spans"], F.array(own))).otherwise(done["spans"]).alias("spans"))

    def by_steps(all_pieces: Column) -> Column:
        last = F.floor((F.size(all_pieces) - 1) / STEPS).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(all_pieces, k * STEPS + 1, STEPS), empty, step))

    def moved(steps: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(steps, none, lambda done, x: F.struct((done["at"] + x["at"]).alias("at"), F.concat(done["starts"], F.array(done["at"])).alias("starts")), lambda done: done["starts"])
        move = lambda s, by: F.struct((s["start"] + by).alias("start"), s["place"].alias("place"), (s["end"] + by).alias("end"), s["kind"].alias("kind"))
        return F.flatten(F.zip_with(steps, starts, lambda x, by: F.transform(x["spans"], lambda s: move(s, by))))

    # transform() over a list of one binds what it holds, so that it is computed once
    steps = F.transform(F.array(pieces), by_steps)
    return F.when(text.rlike(rule.pattern), F.transform(steps, moved)[0]).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", rules=RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """versions (path, text): every version that any path ever had -> (paths, new).

    paths: path, blob, spans: a row per version, with all rules' findings by start and then rule.
    new: blob, rule, version, spans: the pairs that were scanned now, for appending to the ledger, which has these columns.
    A blob's text is read once, from the first of its paths.
    """
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    held = staged(texts.select("path", "blob"), "secret-blobs")
    blobs = held.groupBy("blob").agg(F.min("path").alias("path"), F.count("*").alias("paths"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        due = blobs.withColumn("due", kinds)
    else:
        versions_of = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
        pairs = blobs.select("blob", "path", F.explode(versions_of).alias("x")).select("blob", "path", "x.*")
        seen = ledger.select("blob", "rule", "version").distinct()
        due = pairs.join(seen, ["blob", "rule", "version"], "left_anti").groupBy("blob", "path").agg(F.collect_set("rule").alias("due"))
    first = due.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), "due").hint("shuffle_hash")
    own = texts.join(first, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob")))
    own = own.select("blob", "due", *[F.when(F.array_contains("due", r.kind), spans(F.col("text"), r, k)).alias(r.kind) for k, r in enumerate(rules)])
    rows = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules]))
    new = own.select("blob", rows.alias("x")).select("blob", "x.*").where("spans is not null")
    new = staged(new.dropDuplicates(["blob", "rule", "version"]), "secret-ledger")
    known = new if ledger is None else new.unionByName(ledger.select("blob", "rule", "version", "spans"))
    current = reduce(lambda a, b: a | b, [(F.col("rule") == r.kind) & (F.col("version") == r.version) for r in rules])
    found = known.where(current & (F.size("spans") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = found.join(blobs.select("blob", "paths"), "blob")
    paths = hot_safe_join(held, found, "blob", "paths", F.col("path"), held.count())
    return paths.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))), new


def told(spans_column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans_column: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by the mark. Long texts are taken a piece at a time."""
    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def marked(piece: Column, k: Column) -> Column:
        low, high = k * PIECE, (k + 1) * PIECE
        own = F.filter(spans_column, lambda s: (s["start"] < high) & (s["end"] > low))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

        def step(done: Column, s: Column) -> Column:
            new = F.concat(done["text"], F.substring(piece, done["at"] + 1, s["start"] - low - done["at"]), F.lit(mark))
            return F.struct(F.greatest(done["at"], s["end"] - low).alias("at"), F.when(s["start"] - low >= done["at"], new).otherwise(done["text"]).alias("text"))

        rest = lambda done: F.concat(done["text"], F.substring(piece, done["at"] + 1, F.lit(PIECE)))
        return F.when(F.size(own) == 0, piece).otherwise(F.aggregate(own, start, step, rest))

    return F.when(F.size(spans_column) == 0, text).otherwise(F.array_join(F.transform(whole, marked), ""))
