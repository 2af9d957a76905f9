"""Time as columns. `now` is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0


#: Days in which a collection's rows lose half their weight; others keep it.
HALF_LIVES = {"personal": 90.0, "context": 30.0, "experience": 180.0, "semantic": 365.0, "patterns": 90.0}
FLOOR = 0.25
EXPIRED = 0.3


def decay(created: Column, collection: Column, valid_until: Column, now: Column) -> Column:
    """0.5 ^ (age / half-life), never under the floor; times EXPIRED for rows whose validity is over."""
    half = F.coalesce(*[F.when(collection == c, F.lit(h)) for c, h in HALF_LIVES.items()])
    age = F.greatest(F.lit(0.0), age_days(created, now))
    weight = F.when(half.isNull() | created.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(FLOOR), F.pow(F.lit(0.5), age / half)))
    return weight * F.when(valid_until < now, F.lit(EXPIRED)).otherwise(F.lit(1.0))


#: Fixed values: (static trust, loss a day) of collections.
TRUST = {"canonical": (1.0, 0.02), "distilled": (0.9, 0.005), "knowledge": (0.9, 0.005), "personal": (0.85, 0.0), "experience": (0.85, 0.0), "semantic": (0.8, 0.0), "context": (0.75, 0.0), "obsidian": (0.6, 0.0), "graph": (0.5, 0.0)}
OTHER_TRUST, TRUST_FLOOR = 0.7, 0.8


def effective_trust(collection: Column, created: Column, now: Column) -> Column:
    """Static trust less what it loses a day, not under the floor; collections that lose none keep theirs."""
    out = F.lit(OTHER_TRUST)
    for name, (trust, loss) in TRUST.items():
        own = F.greatest(F.lit(TRUST_FLOOR), F.lit(trust) - F.lit(loss) * F.greatest(F.lit(0.0), age_days(created, now))) if loss else F.lit(trust)
        out = F.when(collection == name, own).otherwise(out)
    return out


def valid_at(valid_from: Column, valid_until: Column, at: Column) -> Column:
    """Half-open; a null end is open."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_until.isNull() | (at < valid_until))
