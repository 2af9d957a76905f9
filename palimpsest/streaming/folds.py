"""Folds over a key's rows that run on streams, with a time to live, as on tables.

A fold keeps what it must of a key, takes rows in order, and gives rows out; `saved` and `load` move what it keeps into the
stream's state and back, as JSON. On a stream a key's rows are sorted within a batch, so a stream that comes in order
gives what `operators.state.folded` gives on the whole table, wherever batches end and restarts fall. Rows behind the
watermark are dropped; a key of which nothing came for its time to live is forgotten by a timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.state import Fold


class Cooldown(Fold):
    """(at in seconds, event) -> (event, count): fires unless the key fired within the cooldown; what is held back doesn't
    put off the next. Rows from before the last fire are held back."""

    def __init__(self, seconds: float):
        self.seconds, self.last, self.count = seconds, None, 0

    def row(self, at, event) -> list[tuple]:
        if self.last is not None and at - self.last < self.seconds:
            return []
        self.last, self.count = at, self.count + 1
        return [(event, self.count)]

    def saved(self):
        return [self.last, self.count]

    def load(self, kept) -> None:
        self.last, self.count = kept


class Habituation(Fold):
    """(at, event, helped) -> (event, shown): a thing shown `threshold` times without help since it last helped is dropped;
    it starts anew if it comes again."""

    def __init__(self, threshold: int):
        self.threshold, self.shown = threshold, 0

    def row(self, at, event, helped) -> list[tuple]:
        self.shown = 0 if helped else self.shown + 1
        if self.shown < self.threshold:
            return []
        shown, self.shown = self.shown, 0
        return [(event, shown)]

    def saved(self):
        return self.shown

    def load(self, kept) -> None:
        self.shown = kept


class SemanticCache(Fold):
    """(at, event, embedding) -> (event, answered_by): the oldest entry younger than `ttl` seconds whose cosine is over
    `like` answers; null if none does, and then the question becomes an entry. Past `most` entries the oldest goes.
    Embeddings are cut to their first `places` and made of length 1."""

    def __init__(self, like: float = 0.92, ttl: float = 60, most: int = 50, places: int = 256):
        self.like, self.ttl, self.most, self.places, self.entries = like, ttl, most, places, []

    def row(self, at, event, embedding) -> list[tuple]:
        head = [float(x) for x in (embedding or [])[: self.places]]
        norm = sum(x * x for x in head) ** 0.5
        if not norm:
            return [(event, None)]
        head = [x / norm for x in head]
        self.entries = [e for e in self.entries if at - e[0] < self.ttl]
        for _, known, own in self.entries:
            if len(own) == len(head) and sum(x * y for x, y in zip(own, head, strict=True)) > self.like:
                return [(event, known)]
        self.entries = [*self.entries, [at, event, head]][-self.most :]
        return [(event, None)]

    def saved(self):
        return self.entries

    def load(self, kept) -> None:
        self.entries = kept


def folded_stream(events: DataFrame, keys: list[str], order: list[str], values: list[str], fold: type[Fold], schema: str, *settings, ts: str = "ts", late: str = "1 hour", ttl_seconds: float = 86_400) -> DataFrame:
    """Like `folded`, on a stream with an event time `ts`. The output has the key's columns, then the fold's."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = fold(*settings)
        if state.exists:
            own.load(json.loads(state.get[0]))
        rows = pd.concat(list(parts)).sort_values(order)
        out = [key + x for r in rows[[*order, *values]].itertuples(index=False, name=None) for x in own.row(*map(plain, r))]
        state.update((json.dumps(own.saved()),))
        newest = int(rows[ts].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + int(ttl_seconds * 1000))
        yield pd.DataFrame(out, columns=names) if out else pd.DataFrame({n: [] for n in names})

    held = events.select(*dict.fromkeys([*keys, *order, *values, ts])).withWatermark(ts, late)
    return held.groupBy(*keys).applyInPandasWithState(work, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def plain(x):
    """A cell as Python has it, so that JSON can hold it."""
    return x.tolist() if hasattr(x, "tolist") else x
