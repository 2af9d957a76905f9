"""How alike two texts are by their longest common blocks: twice the letters in these over all letters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pairs, and cells of a table of common ends, that are looked at together.
TOGETHER, CELLS = 4096, 1 << 22


def letters(texts: list[str]) -> np.ndarray:
    """A row of code points a text, -1 after its end."""
    out = np.full((len(texts), max(1, max(map(len, texts), default=0))), -1, dtype=np.int32)
    for k, s in enumerate(texts):
        out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return out


def longest(a: np.ndarray, b: np.ndarray, rows: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """start in a, start in b, length of the longest common block of each pair (rows) within spans (of a, then of b); of
    several the one that starts first in a, then in b. All pairs take a step along a at once."""
    low, high, left, right = spans.T
    wide, tall = int((right - left).max()), int((high - low).max())
    at = np.minimum(left[:, None] + np.arange(wide), b.shape[1] - 1)
    there = np.where(np.arange(wide) < (right - left)[:, None], b[rows[:, None], at], -2)
    ends = np.zeros((len(rows), wide + 1), dtype=np.int32)
    best = np.zeros((len(rows), 3), dtype=np.int64)
    every = np.arange(len(rows))
    for i in range(tall):
        here = np.where(low + i < high, a[rows, np.minimum(low + i, a.shape[1] - 1)], -3)
        ends[:, 1:] = np.where(there == here[:, None], ends[:, :-1] + 1, 0)
        j = ends.argmax(axis=1)
        n = ends[every, j]
        more = n > best[:, 2]
        best[more] = np.stack([low + i + 1 - n, left + j - n, n], axis=1)[more]
    return best


def matched(first: list[str], second: list[str]) -> np.ndarray:
    """Letters in common blocks: the longest, then the longest on its left and on its right, and so on."""
    a, b = letters(first), letters(second)
    out = np.zeros(len(first), dtype=np.int64)
    rows = np.arange(len(first))
    spans = np.array([(0, len(x), 0, len(y)) for x, y in zip(first, second, strict=True)], dtype=np.int64).reshape(-1, 4)
    while len(rows):
        open_ = (spans[:, 1] > spans[:, 0]) & (spans[:, 3] > spans[:, 2])
        rows, spans = rows[open_], spans[open_]
        if not len(rows):
            break
        found = np.concatenate([longest(a, b, r, s) for r, s in some(rows, spans)])
        np.add.at(out, rows, found[:, 2])
        hit = found[:, 2] > 0
        rows, spans, found = rows[hit], spans[hit], found[hit]
        before = np.stack([spans[:, 0], found[:, 0], spans[:, 2], found[:, 1]], axis=1)
        after = np.stack([found[:, 0] + found[:, 2], spans[:, 1], found[:, 1] + found[:, 2], spans[:, 3]], axis=1)
        rows, spans = np.concatenate([rows, rows]), np.concatenate([before, after])
    return out


def some(rows: np.ndarray, spans: np.ndarray):
    """Pairs together while their tables stay small."""
    step = max(1, min(TOGETHER, CELLS // max(1, int((spans[:, 3] - spans[:, 2]).max()))))
    for k in range(0, len(rows), step):
        yield rows[k : k + step], spans[k : k + step]


@F.pandas_udf(DoubleType())
def _ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    out = []
    for k in range(0, len(first), TOGETHER):
        a, b = first[k : k + TOGETHER].tolist(), second[k : k + TOGETHER].tolist()
        all_ = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
        out.append(np.where(all_ == 0, 1.0, 2.0 * matched(a, b) / np.maximum(all_, 1)))
    return pd.Series(np.concatenate(out) if out else np.zeros(0))


def ratio(a: Column, b: Column) -> Column:
    """0 to 1; a null text counts as empty, and two empty ones are alike. For texts of a line; the work of a pair is the product of their
    lengths."""
    return _ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def ratio_at_most(a: Column, b: Column) -> Column:
    """What the ratio can't exceed, from lengths alone."""
    x, y = (F.length(F.coalesce(s, F.lit(""))) for s in (a, b))
    return F.when(x + y == 0, 1.0).otherwise(2 * F.least(x, y) / (x + y))
