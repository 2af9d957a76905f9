"""Notes cut into chunks: by headings, by dated entries, small sections merged. Cutting is a column; merging is a fold over
one note's sections, which are an array of its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_frontmatter(text: Column) -> Column:
    """The note without the block of fields that it may start with."""
    return F.regexp_replace(text, r"^---(?:json)?\s*\n(?s:.*?)\n---\s*\n", "")


def _kept(parts: Column, least: int) -> Column:
    trimmed = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")))
    return F.filter(trimmed, lambda p: F.length(p) > least)


def by_heading(notes: DataFrame, note_id: str, text: str, least: int = 50) -> DataFrame:
    """note_id, place, section, content: a chunk for each heading of the first three levels, with what follows it; chunks
    of `least` characters or fewer go; a note without any chunk is one."""
    body = without_frontmatter(F.coalesce(F.col(text), F.lit("")))
    parts = _kept(F.split(body, r"\n(?=#{1,3}\s)"), least)
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(body))
    rows = notes.select(note_id, F.size(parts).alias("_n"), F.posexplode(whole).alias("place", "content"))
    heading = F.regexp_extract("content", r"^#{1,3}\s+([^\n]*)", 1)
    return rows.select(note_id, "place", F.when(F.col("_n") == 0, "full").when(heading == "", "intro").otherwise(F.trim(heading)).alias("section"), "content")


def by_date(notes: DataFrame, note_id: str, text: str, least: int = 30) -> DataFrame:
    """note_id, place, section, content: a chunk for each entry that starts with a date or a heading."""
    parts = _kept(F.split(F.coalesce(F.col(text), F.lit("")), r"\n(?=\d{4}-\d{2}-\d{2}|#{1,3}\s)"), least)
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.coalesce(F.col(text), F.lit(""))))
    rows = notes.select(note_id, F.size(parts).alias("_n"), F.posexplode(whole).alias("place", "content"))
    return rows.select(note_id, "place", F.when(F.col("_n") == 0, "full").otherwise(F.substring("content", 1, 80)).alias("section"), "content")


def merged_sections(sections: DataFrame, note_id: str, target: int = 700, most: int = 1500) -> DataFrame:
    """sections (note_id, place, section, content) -> the same with small neighbours joined, until they reach `target`
    characters; none is joined that would make more than `most`."""
    listed = sections.groupBy(note_id).agg(F.array_sort(F.collect_list(F.struct("place", "section", "content"))).alias("parts"))
    chunk = "struct<section:string,content:string,full:boolean>"
    empty = F.array().cast(f"array<{chunk}>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & ~F.coalesce(last["full"], F.lit(True)) & (F.length(last["content"]) + F.length(x["content"]) + 4 <= most)
        content = F.when(joins, F.concat_ws("\n\n", last["content"], x["content"])).otherwise(x["content"])
        section = F.when(joins, F.concat_ws(" + ", last["section"], x["section"])).otherwise(x["section"])
        new = F.struct(section.alias("section"), content.alias("content"), (F.length(content) + 2 >= target).alias("full"))
        kept = F.when(joins, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.concat(kept, F.array(new))

    merged = listed.select(note_id, F.posexplode(F.aggregate("parts", empty, step)).alias("place", "x"))
    return merged.select(note_id, "place", F.col("x.section").alias("section"), F.col("x.content").alias("content"))
