"""State of facts over time: spaced repetition, the confidence ledger, versions, breakers.

Steps that commute are columns and aggregates. Folds that don't, because of a clamp, run over one key's ordered events;
their state is a number or two, so a key's events are folded in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.02, 0.98
TIERS = ("obsolete", "episodic", "semantic", "core")


def tier_rank(tier: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(TIERS):
        out = F.when(tier == name, F.lit(k)).otherwise(out)
    return out


def sm2(easiness: Column, reinforced: Column, interval: Column, quality: Column) -> tuple[Column, Column, Column]:
    """One review: the new easiness, count and interval in days."""
    miss = 5 - quality
    ef = F.greatest(F.lit(1.3), easiness + 0.1 - miss * (0.08 + miss * 0.02))
    n = F.when(quality < 3, F.lit(0)).otherwise(reinforced + 1)
    days = F.when((quality < 3) | (reinforced == 0), F.lit(1.0)).when(reinforced == 1, F.lit(6.0)).otherwise(interval * ef)
    return ef, n, days


def promoted(tier: Column, reinforced: Column, interval: Column, canonical: Column) -> Column:
    return F.when((tier == "episodic") & (reinforced >= 2) & (interval >= 6), "semantic").when((tier == "semantic") & (reinforced >= 5) & (interval >= 30) & ~canonical, "core").otherwise(tier)


def rolled_back(weights: Column) -> Column:
    """0.5 moved by a sum of logits, clamped once."""
    return F.least(F.lit(HIGH), F.greatest(F.lit(LOW), 1 / (1 + F.exp(-weights))))


class Fold:
    """What is kept of one key while its rows go by in order: each row, and the end, give rows out."""

    def row(self, *values) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def folded(events: DataFrame, keys: list[str], order: list[str], values: list[str], fold: type[Fold], schema: str, *settings) -> DataFrame:
    """Each key's rows in order through a fold of its own. Keys are dealt to partitions and sorted there, so that a
    partition is read once in a stream: no group is ever held, and a key costs no call of its own. The key's columns
    come before what the fold gives out."""
    columns = [*keys, *order, *values]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        out: list[tuple] = []
        names = names_of(schema)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * len(names), names.values(), strict=True)], names=list(names))

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                key = row[: len(keys)]
                if state is None or key != last:
                    out += [last + x for x in state.end()] if state is not None else []
                    last, state = key, fold(*settings)
                out += [key + x for x in state.row(*row[len(keys) :])]
            yield batch_of(out)
            out = []
        yield batch_of([last + x for x in state.end()] if state is not None else [])

    dealt = events.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(work, schema)


def names_of(schema: str) -> dict[str, pa.DataType]:
    """The columns of a schema of longs, doubles, strings and booleans."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return {n: kinds[k] for n, k in (c.split() for c in schema.split(", "))}


class Ledger(Fold):
    def __init__(self, start: float):
        self.p = start

    def row(self, event_id, weight, cluster) -> list[tuple]:
        z = math.log(self.p / (1 - self.p)) + weight / max(1, cluster)
        self.p = min(HIGH, max(LOW, 1 / (1 + math.exp(-z))))
        return []

    def end(self) -> list[tuple]:
        return [(self.p,)]


def ledger(events: DataFrame, start: float = 0.5) -> DataFrame:
    """events (atom, event_id, weight, cluster) -> (atom, confidence): each event adds weight / cluster to the logit, and
    the result is clamped at each step."""
    return folded(events, ["atom"], ["event_id"], ["weight", "cluster"], Ledger, "atom long, confidence double", start)


class Utility(Fold):
    def __init__(self, start: float, up: float, down: float):
        self.u, self.up, self.down = start, up, down

    def row(self, event_id, success) -> list[tuple]:
        self.u = min(1.0, max(0.0, self.u + (self.up if success else -self.down)))
        return []

    def end(self) -> list[tuple]:
        return [(self.u,)]


def utility(events: DataFrame, start: float = 0.5, up: float = 0.1, down: float = 0.05) -> DataFrame:
    """events (atom, event_id, success) -> (atom, utility), clamped to [0, 1] at each step."""
    return folded(events, ["atom"], ["event_id"], ["success"], Utility, "atom long, utility double", start, up, down)


class Versions(Fold):
    """Only the current version waits for what becomes of it."""

    def __init__(self):
        self.current = None

    def row(self, seq, value, confidence) -> list[tuple]:
        if self.current is None:
            self.current = (seq, value, confidence)
        elif value == self.current[1]:
            return [(seq, "confirmed", None)]
        elif confidence >= self.current[2]:
            before, self.current = self.current, (seq, value, confidence)
            return [(before[0], "superseded", seq)]
        else:
            return [(seq, "superseded", self.current[0])]
        return []

    def end(self) -> list[tuple]:
        return [(self.current[0], "active", None)]


def fact_versions(facts: DataFrame) -> DataFrame:
    """facts (entity, attribute, value, seq, confidence) -> each with its status: an equal value confirms the current one,
    another of at least its confidence takes its place, a weaker one is kept as superseded."""
    return folded(facts, ["entity", "attribute"], ["seq"], ["value", "confidence"], Versions, "entity string, attribute string, seq long, status string, superseded_by long")


class Breaker(Fold):
    def __init__(self, failures: int, rest: int):
        self.failures, self.rest, self.state, self.bad, self.away = failures, rest, "closed", 0, 0

    def row(self, seq, ok) -> list[tuple]:
        if self.state == "open":
            self.away += 1
            self.state = "half-open" if self.away >= self.rest else "open"
        elif ok:
            self.state, self.bad = "closed", 0
        else:
            self.bad += 1
            if self.state == "half-open" or self.bad >= self.failures:
                self.state, self.away, self.bad = "open", 0, 0
        return [(seq, self.state)]


def breaker(events: DataFrame, failures: int, rest: int) -> DataFrame:
    """events (kind, seq, ok) -> (kind, seq, state): it opens after so many failures in a row, lets one event try after so
    many were turned away, and closes if that one succeeds."""
    return folded(events, ["kind"], ["seq"], ["ok"], Breaker, "kind long, seq long, state string", failures, rest)


class Valence(Fold):
    """A running mean in whole numbers of 1e-4, rounded at each step, halves to the even one."""

    def __init__(self):
        self.mean, self.n = 0, 0

    def row(self, event_id, delta) -> list[tuple]:
        units = round(min(1.0, max(-1.0, delta)) * 10_000)
        self.n += 1
        self.mean, rest = divmod(self.mean * (self.n - 1) + units, self.n)
        self.mean += 2 * rest > self.n or (2 * rest == self.n and self.mean % 2 == 1)
        return []

    def end(self) -> list[tuple]:
        return [(self.mean / 10_000, self.n)]


def valence(events: DataFrame) -> DataFrame:
    """events (atom, event_id, delta) -> (atom, valence, events): the mean of deltas in [-1, 1], kept to 4 places."""
    return folded(events, ["atom"], ["event_id"], ["delta"], Valence, "atom long, valence double, events long")
