"""Whitening of embeddings by an exact scatter matrix.

Vectors are whole numbers x. Each task reduces its rows modulo several primes and multiplies the residues as matrices of
doubles: residues are centred, under 2^20 in size, and multiplied CHUNK rows at a time, so that every sum stays below 2^53
and is exact. What leaves a task is a row of residues a prime and dimension; they are added up in bounded groups, and the
driver puts the residues of each entry together by Chinese remaindering. There are as many primes as the count of rows and
the largest entry ask for, so the scatter is exact for any number of rows. From it come the covariance, in whole numbers
divided once, and its eigenvectors in double precision (symmetric eigendecomposition on the driver: a matrix of dimensions
by dimensions, whatever the rows). Rows are projected in tasks; the covariance of what was projected is summed up by
merging centred partial ones.

Nulls and odd cases: null or empty vectors, and those with a null or non-finite entry, are dropped; whole numbers beyond
2^62 are taken as 2^62; vectors of different lengths are fitted apart, each length by its own rows (their number of
different lengths, and lengths, bound what the driver holds); repeated rows and rows without an id count as they are;
components without variance give 0, explained 0, and don't enter identity_error; deviations beyond 64 bits are given as
the largest 64-bit integer; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, session_of, staged

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
MOST_X = 1 << 62
#: Primes lie under this; half of it, squared, CHUNK times is below 2^53.
PRIME_BITS = 21
CHUNK = 1 << 12
#: Partial rows that are added up in one group.
AT_ONCE = 4096
LARGEST = (1 << 63) - 1


def primes(product_over: int) -> list[int]:
    """The largest primes under 2^PRIME_BITS, as many as it takes for their product to exceed a number."""
    found, product, n = [], 1, (1 << PRIME_BITS) - 1
    while product <= product_over:
        if all(n % k for k in range(3, math.isqrt(n) + 1, 2)):
            found.append(n)
            product *= n
        n -= 2
    return found


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The number nearest to zero that has these residues."""
    x, m = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += m * ((int(r) - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if 2 * x > m else x


def wholes(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 as 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * vectors)
    return np.clip(x, -float(MOST_X), float(MOST_X)).astype(np.int64) + SHIFT


def fit_list(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, c: the rows that take part."""
    c = F.transform(F.col(embedding), lambda v: v.cast("double"))
    good = (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, vectors) for each length."""
    c = batch.column(batch.schema.get_field_index("c"))
    lengths = np.diff(c.offsets.to_numpy())
    flat, starts = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()[:-1]
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def scatter_parts(vectors: DataFrame, moduli: list[int]) -> DataFrame:
    """d, prime (its place), i, row: residues of the scatter's row i; i = -1: of the sums."""
    schema = pa.schema([("d", pa.int32()), ("prime", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.int64())), ("slot", pa.int32())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, c in matrices(batch):
                x, d = wholes(c), c.shape[1]
                acc = sums.setdefault(d, np.zeros((len(moduli), d + 1, d), dtype=np.int64))
                for k, p in enumerate(moduli):
                    r = x % p
                    acc[k, d] = (acc[k, d] + r.sum(axis=0)) % p
                    r = (r - p * (2 * r > p)).astype(float)
                    for low in range(0, len(r), CHUNK):
                        some = r[low : low + CHUNK]
                        acc[k, :d] = (acc[k, :d] + (some.T @ some).astype(np.int64)) % p
        slot = TaskContext.get().partitionId()
        for d, acc in sums.items():
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array([k] * (d + 1), pa.int32()), pa.array([*range(d), -1], pa.int32()), pa.array(list(acc[k]), pa.list_(pa.int64())), pa.array([slot] * (d + 1), pa.int32())], schema=schema)
        give_back()

    return vectors.select("c").mapInArrow(multiply, "d int, prime int, i int, row array<long>, slot int")


def added_up(parts: DataFrame, moduli: list[int], tasks: int) -> DataFrame:
    """One row a (d, prime, i): partial rows are added in groups of AT_ONCE tasks until one is left."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.column("row").combine_chunks()
        d = key[0].as_py()
        total = rows.flatten().to_numpy().reshape(-1, d).sum(axis=0) % moduli[key[1].as_py()]
        return pa.table({"d": [d], "prime": [key[1].as_py()], "i": [key[2].as_py()], "row": [total.tolist()], "slot": [key[3].as_py()]}, schema=pa.schema([("d", pa.int32()), ("prime", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.int64())), ("slot", pa.int32())]))

    while True:
        parts = parts.withColumn("slot", F.floor(F.col("slot") / AT_ONCE).cast("int")).groupBy("d", "prime", "i", "slot").applyInArrow(add, "d int, prime int, i int, row array<long>, slot int")
        tasks = -(-tasks // AT_ONCE)
        if tasks <= 1:
            return parts


@dataclass
class Model:
    """Of one length of vectors: rows, exact sums, exact scatter, and the components that were asked for."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def alive(self) -> np.ndarray:
        """Components with variance: more than rounding leaves."""
        return self.values > 1e-13 * max(self.trace, 0.0) if self.trace > 0 else np.zeros(len(self.values), dtype=bool)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, projected on the components, over the roots of their eigenvalues."""
        root = np.sqrt(np.where(self.alive, self.values, 1.0))
        return np.where(self.alive, (self.deviations(x) / self.n).astype(float) @ self.vectors / root, 0.0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: in 64-bit integers if they hold it."""
        most = self.n * max(MOST_X if len(x) == 0 else int(np.abs(x).max()), 1) + max(map(abs, self.sums))
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def squares(self, x: np.ndarray) -> np.ndarray:
        """The sum of (n * x - S)^2 of each row, exactly, at most LARGEST."""
        v = self.deviations(x)
        about = (v.astype(float) ** 2).sum(axis=1)
        out = np.full(len(x), LARGEST, dtype=np.int64)
        sure = about < 9.2e18
        if v.dtype != object:
            out[sure] = (v[sure] ** 2).sum(axis=1)
        else:
            out[sure] = [sum(int(y) ** 2 for y in row) for row in v[sure]]
        for k in np.flatnonzero(~sure & (about < 9.3e18)).tolist():
            out[k] = min(LARGEST, sum(int(y) ** 2 for y in v[k]))
        return out


def model_of(n: int, sums: list[int], scatter: list[list[int]], components: int) -> Model:
    """Covariances are whole numbers over n^2, divided once."""
    square = n * n
    v = np.array([[(n * s - a * b) / square for s, b in zip(row, sums, strict=True)] for row, a in zip(scatter, sums, strict=True)])
    trace = sum(n * scatter[i][i] - sums[i] ** 2 for i in range(len(sums))) / square
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return Model(n, sums, scatter, values, vectors * np.where(sign == 0, 1, sign), trace)


def fit(held: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vectors. The driver gets one number a prime and entry of the scatter."""
    known = held.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max("c")).alias("high"), F.min(F.array_min("c")).alias("low")).collect()
    if not known:
        return {}
    counts = {r["d"]: r["n"] for r in known}
    most = max(max(abs(int(y)) for y in wholes(np.array([r["high"], r["low"]]))) for r in known)
    moduli = primes(2 * max(counts.values()) * most**2 + 1)
    parts = staged(scatter_parts(held, moduli), "whitening-residues")
    tasks = (parts.agg(F.max("slot")).first()[0] or 0) + 1
    residues: dict[tuple[int, int, int], list[int]] = {(r["d"], r["prime"], r["i"]): r["row"] for r in added_up(parts, moduli, tasks).collect()}
    models = {}
    for d, n in counts.items():
        entry = lambda i, d=d: [remaindered(x, moduli) for x in zip(*(residues[d, k, i] for k in range(len(moduli))), strict=True)]
        models[d] = model_of(n, entry(-1), [entry(i) for i in range(d)], components)
    return models


def identity_errors(held: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """For each length, the largest entry of what its whitened rows' covariance departs from the identity by."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, c in matrices(batch):
                w = models[c.shape[1]].whiten(wholes(c))
                mean = w.mean(axis=0)
                sums[c.shape[1]] = merged(sums.get(c.shape[1]), (len(w), mean, (w - mean).T @ (w - mean)))
        for d, (n, mean, m) in sums.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "n": [n], "mean": [mean.tolist()], "m": [m.ravel().tolist()]}, schema=pa.schema([("d", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m", pa.list_(pa.float64()))]))

    def together(key: tuple, table: pa.Table) -> pa.Table:
        whole = None
        for r in sorted(table.to_pylist(), key=lambda r: (r["n"], r["mean"])):
            whole = merged(whole, (r["n"], np.array(r["mean"]), np.array(r["m"]).reshape(len(r["mean"]), -1)))
        n, mean, m = whole
        return pa.table({"d": [key[0].as_py()], "slot": [key[1].as_py()], "n": [n], "mean": [mean.tolist()], "m": [m.ravel().tolist()]}, schema=pa.schema([("d", pa.int32()), ("slot", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m", pa.list_(pa.float64()))]))

    schema = "d int, n long, mean array<double>, m array<double>"
    parts = staged(held.select("c").mapInArrow(partial, schema).withColumn("slot", F.spark_partition_id()), "whitening-partial")
    tasks = (parts.agg(F.max("slot")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("slot", F.floor(F.col("slot") / AT_ONCE).cast("int")).groupBy("d", "slot").applyInArrow(together, "d int, slot int, n long, mean array<double>, m array<double>")
        tasks = -(-tasks // AT_ONCE)
        if tasks <= 1:
            break
    errors = {}
    for r in parts.collect():
        alive = models[r["d"]].alive
        off = np.array(r["m"]).reshape(len(alive), -1) / r["n"] - np.eye(len(alive))
        errors[r["d"]] = float(np.abs(off[np.ix_(alive, alive)]).max(initial=0.0))
    return errors


def merged(a: tuple | None, b: tuple) -> tuple:
    """Counts, means and centred products of two sets of rows, of both together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    held = fit_list(vectors, vec_id, embedding)
    models = fit(held, components)
    models = {d: replace(m, scatter=[]) for d, m in models.items()}  # tasks don't need it
    errors = identity_errors(held, models)
    worst = max(errors.values(), default=0.0)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, c in matrices(batch):
                model, x = models[c.shape[1]], wholes(c)
                k = len(model.values)
                again = lambda v, k=k: np.repeat(v, k)
                explained = np.where(model.alive, model.values / model.trace if model.trace > 0 else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(again(at))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(k * len(at), model.n)), pa.array(again(model.squares(x))), pa.array(model.whiten(x).ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(k * len(at), worst))],
                    schema=schema,
                )
        give_back()

    return held.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
