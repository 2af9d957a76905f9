"""Ranking stages: each takes and returns candidates and changes only their score. Order is meaning, so a chain is a list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import temporal, text


@dataclass(frozen=True)
class Stage:
    """A named step from candidates to candidates, which can be switched off."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    enabled: bool = True


def run(candidates: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        if stage.enabled:
            candidates = stage.apply(candidates)
    return candidates


def scaled(factor: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda c: c.withColumn("score", F.col("score") * factor)


def added(amount: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda c: c.withColumn("score", F.col("score") + amount)


def position_bonus(first: Column, gamma: float = 0.5, span: float = 500) -> Column:
    """1 + gamma * (1 - place / span) for a first match at a place from 0; 1 if there is none (negative)."""
    return F.when(first < 0, F.lit(1.0)).otherwise(1 + gamma * F.greatest(F.lit(0.0), 1 - first / span))


def overlap_rerank(query: Column, title: Column, body: Column) -> Column:
    """1 + 2 * title overlap + body overlap; rows with next to none of either lose."""
    t, b = text.jaccard(query, title), text.jaccard(query, body)
    return (1 + 2 * t + b) * F.when((t == 0) & (b < 0.05), 0.6).otherwise(1.0)


#: Fixed values: (kind of source, factor).
SOURCE_QUALITY = {"session_dump": 0.4, "derived": 0.85, "log": 0.7}


def source_quality(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, factor in SOURCE_QUALITY.items():
        out = F.when(kind == name, F.lit(factor)).otherwise(out)
    return out


def deboost(weight: Column) -> Column:
    return F.when(weight < 0.5, 0.7 + 0.5 * weight).otherwise(1.0)


def valence_boost(valence: Column) -> Column:
    """Up to 15 % up for 1, up to 10 % down for -1."""
    return F.when(valence > 0, 1 + 0.15 * F.least(valence, F.lit(1.0))).when(valence < 0, 1 + 0.10 * F.greatest(valence, F.lit(-1.0))).otherwise(1.0)


def trust_multiplier(trust: Column) -> Column:
    return 0.4 + 0.6 * F.coalesce(trust, F.lit(0.7))


def salience(age: Column, trust: Column, accesses: Column, half_life: float = 90) -> Column:
    """Up to 10: mean of recency and importance, which is the mean of trust and log accesses."""
    importance = (F.least(F.coalesce(trust, F.lit(0.7)), F.lit(1.0)) + F.least(F.log1p(accesses) / F.log(F.lit(50.0)), F.lit(1.0))) / 2
    return 10 * (F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life) + importance) / 2


def ltr(features: list[Column], weights: list[float], bias: float, blend: float = 0.25) -> Callable[[DataFrame], DataFrame]:
    """(1 - blend) of the score, blend of a logistic model's 100 * p."""
    z = F.lit(bias)
    for f, w in zip(features, weights, strict=True):
        z = z + f * F.lit(w)
    return lambda c: c.withColumn("score", (1 - blend) * F.col("score") + blend * 100 / (1 + F.exp(-z)))


def support(confidence: Column, trust: Column, quality: Column, expired: Column, stale: Column) -> Column:
    base = 0.5 * confidence + 0.35 * F.coalesce(trust, F.lit(0.5)) + 0.15 * quality
    return base * F.when(expired, 0.4).when(stale, 0.7).otherwise(1.0)


#: Fixed values.
AUTHORITY = {"core": 0.45, "canonical": 0.40, "semantic": 0.30, "episodic": 0.10, "raw": 0.05, "obsolete": -0.60}


def authority(tier: Column, confidence: Column, trust: Column, canonical: Column, inactive: Column) -> Column:
    out = F.lit(0.0)
    for name, value in AUTHORITY.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out + 0.35 * confidence + 0.20 * F.coalesce(trust, F.lit(0.0)) + F.when(canonical, 0.15).otherwise(0.0) - F.when(inactive, 0.85).otherwise(0.0)


def decayed(now: Column) -> Callable[[DataFrame], DataFrame]:
    return scaled(temporal.decay(F.col("created_at"), F.col("collection"), F.col("valid_until"), now))
