"""Predicates: the filter language, and the rules by which rows of the truth table are shown."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def compile_filter(where: dict[str, Any] | None) -> Column:
    """{"field": value | {"$op": value}, "$and": [...], "$or": [...]} as a Column.

    A bare value is equality. $ne and $nin keep rows whose field is null; all other comparisons drop them. An empty filter
    keeps every row; several keys of one level are joined by "and". An unknown operator raises ValueError.
    """
    if not where:
        return F.lit(True)
    parts: list[Column] = []
    for key, value in where.items():
        if key == "$and":
            parts += [compile_filter(w) for w in value]
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, [compile_filter(w) for w in value]) if value else F.lit(False))
        elif isinstance(value, dict):
            parts += [comparison(F.col(key), op, v) for op, v in value.items()]
        else:
            parts.append(F.coalesce(F.col(key) == F.lit(value), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def comparison(c: Column, op: str, value: Any) -> Column:
    if op == "$eq":
        return F.coalesce(c == F.lit(value), F.lit(False))
    if op == "$ne":
        return ~c.eqNullSafe(F.lit(value))
    if op == "$in":
        return F.coalesce(c.isin(list(value)), F.lit(False)) if value else F.lit(False)
    if op == "$nin":
        return ~F.coalesce(c.isin(list(value)), F.lit(False)) if value else F.lit(True)
    if op in COMPARE:
        return F.coalesce(COMPARE[op](c, F.lit(value)), F.lit(False))
    raise ValueError(f"unknown operator {op}")


TRUST_FLOOR = 0.3


def hygiene(now: Column, owner: str = "owner", history: bool = False) -> Column:
    """What a plain recall shows: nothing superseded, obsolete, provisional, of another speaker, bound to a session,
    distrusted or expired. Unknown trust and open validity pass."""
    shown = [
        F.lit(history) | F.col("superseded_by").isNull(),
        F.col("tier") != "obsolete",
        ~F.col("provisional"),
        (F.col("speaker") == owner) | F.col("speaker").startswith("canonical"),
        F.col("scope") != "session",
        F.col("trust").isNull() | (F.col("trust") >= TRUST_FLOOR),
        F.col("valid_until").isNull() | (F.col("valid_until") >= now),
    ]
    return reduce(lambda a, b: a & b, shown)
