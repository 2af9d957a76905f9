"""Time expressions as columns: rules over a text column and a `now` of each row, without Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.intervals import DAYS, UNIT_DAYS

ISO = r"^\d{4}-\d{2}-\d{2}([t ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(z|[+-]\d{2}:\d{2})?)?$"
AMOUNT = r"^(\d{1,6}) ?([a-z]+)( ago)?$"
#: What in a text tells a time.
ANCHOR = r"(?i)\b(today|yesterday|tomorrow|(?:this|last) (?:week|month|year)|last (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|\d{1,6} (?:hours?|days?|weeks?|months?|years?) ago|\d{4}-\d{2}-\d{2})\b"
DAY = 86_400_000_000


def moved(at: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + micros)


def looked_up(name: Column, values: dict[str, int]) -> Column:
    """The value of a name; null if it has none."""
    found = F.lit(None).cast("long")
    for value in sorted(set(values.values())):
        found = F.when(name.isin(*[k for k, v in values.items() if v == value]), F.lit(value).cast("long")).otherwise(found)
    return found


def span(expression: Column, now: Column) -> Column:
    """A struct (since, until) of what an expression means at its row's time; nulls if it is none. Periods have an end."""
    x = F.trim(F.regexp_replace(F.lower(expression), r"\s+", " "))
    now = now.cast("timestamp")
    day = F.date_trunc("day", now)
    none = F.lit(None).cast("timestamp")
    rules: list[tuple[Column, Column, Column]] = [
        (x == "now", now, none),
        (x == "today", day, none),
        (x == "yesterday", moved(day, F.lit(-DAY)), none),
        (x == "tomorrow", moved(day, F.lit(DAY)), none),
    ]
    for unit, months in (("month", 1), ("year", 12)):
        start = F.date_trunc(unit, now)
        step = lambda k, start=start, months=months: F.add_months(start, k * months).cast("timestamp")
        rules += [(x == f"this {unit}", start, step(1)), (x == f"last {unit}", step(-1), start)]
    week = F.date_trunc("week", now)
    rules += [(x == "this week", week, moved(week, F.lit(7 * DAY))), (x == "last week", moved(week, F.lit(-7 * DAY)), week)]
    micros = looked_up(F.regexp_extract(x, AMOUNT, 2), {k: round(d * DAY) for k, d in UNIT_DAYS.items()})
    amount = F.regexp_extract(x, AMOUNT, 1).try_cast("long")
    rules.append((x.rlike(AMOUNT) & micros.isNotNull(), moved(now, -amount * micros), none))
    wanted = looked_up(F.regexp_replace(x, "^last ", ""), DAYS)
    back = F.pmod(F.weekday(now) - wanted, F.lit(7))
    back = F.when((back == 0) & x.startswith("last "), 7).otherwise(back)
    rules.append((wanted.isNotNull(), moved(day, -back * DAY), none))
    rules.append((x.rlike(ISO), F.upper(x).try_cast("timestamp"), none))
    since, until = none, none
    for when, a, b in reversed(rules):
        since, until = F.when(when, a).otherwise(since), F.when(when, b).otherwise(until)
    return F.struct(since.alias("since"), until.alias("until"))


def anchors(text: Column) -> Column:
    """All time expressions in a whole text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANCHOR), F.lit(1))


def spoken_of(text: Column, now: Column) -> Column:
    """A struct (since, until) of what a text speaks of: its first expression's time; until now unless that is a period or
    a day."""
    def stretch(first: Column) -> Column:
        s = span(first, now)
        long = first.rlike("(?i)week|month|year|hour")
        end = F.when(s["since"].isNull(), F.lit(None).cast("timestamp")).when(long, now.cast("timestamp")).otherwise(moved(s["since"], F.lit(DAY)))
        return F.struct(s["since"].alias("since"), F.coalesce(s["until"], end).alias("until"))

    return F.get(F.transform(F.slice(anchors(text), 1, 1), stretch), F.lit(0))
