"""Measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ndcg_at(rank: Column, k: int) -> Column:
    """Of one relevant result at a rank from 1; 0 beyond k or if there is none."""
    return F.when((rank >= 1) & (rank <= k), 1 / F.log2(rank + 1)).otherwise(F.lit(0.0))


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank > 0, 1 / F.nullif(rank, F.lit(0))).otherwise(F.lit(0.0))


def logistic_fit(rows, x: str, y: str, rounds: int = 20, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic model by Newton's method; each round's gradient and curvature are one aggregate,
    so the rows stay where they are. A slope that isn't positive gives (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col(x) + F.lit(b))))
        w, e = p * (1 - p), p - F.col(y)
        ga, gb, haa, hab, hbb = (v or 0.0 for v in rows.agg(F.sum(e * F.col(x)), F.sum(e), F.sum(w * F.col(x) * F.col(x)), F.sum(w * F.col(x)), F.sum(w)).first())
        ga, gb, haa, hbb = ga + ridge * a, gb + ridge * b, haa + ridge, hbb + ridge
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)
