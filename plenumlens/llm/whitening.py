"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the spectrum of its rows' scatter matrix and changes it with every row by a
centred rank-one update: the new eigenvalues are the roots of a secular equation, after
deflation of directions that the update doesn't touch and of equal eigenvalues. Tasks' spectra
are combined by further rank-one updates, some at a time, until one is left. Its vectors span a
Rayleigh-Ritz problem over all rows, solved exactly: rounding of many updates ends there.

Entries become whole numbers, so that sums, means and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumlens.session import materialize

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Finite entries beyond this size count as not finite.
LARGEST = 2.0 ** 40
#: Partial results that one call combines.
FAN_IN = 16
#: Rows of the output made at once, times components.
ROWS_AT_ONCE = 2_000

_EPS = np.finfo(float).eps
#: A root is found when the terms of its equation cancel but for this share of them; the
#: vectors are made orthogonal for whatever roots are found.
_CLOSE = 1e-13
_ROUNDS = 80


# --- rank-one updates ---

def secular_roots(d: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """d[i] - root[j] for the roots of 1 + sum(weights / (d - x)) = 0; d ascends strictly, weights are above 0.

    Each root is sought from the pole next to it, so that its distances keep their digits: steps
    of a model with the two poles around the root, halving where a step leaves the bracket.
    """
    m = len(d)
    gap = np.append(np.diff(d), weights.sum())
    inner = np.arange(m) < m - 1
    far = d[:, None] - (d + gap / 2)
    right = (1 + (weights[:, None] / far).sum(axis=0) < 0) & inner  # the root lies in the right half
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    delta = d[:, None] - origin
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(inner, gap / 2, gap))
    left_pole = d - origin
    right_pole = np.where(inner, np.append(d[1:], 0.0) - origin, 0.0)
    x = (low + high) / 2
    for _ in range(_ROUNDS):
        away = delta - x
        part = weights[:, None] / away
        value = 1 + part.sum(axis=0)
        done = np.abs(value) <= _CLOSE * (1 + np.abs(part).sum(axis=0))
        if done.all():
            break
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        slope = part / away
        sums = np.cumsum(slope, axis=0)
        before = sums.diagonal()
        after = sums[-1] - before
        l, r = left_pole - x, right_pole - x
        with np.errstate(all="ignore"):
            s1, s2 = before * l * l, after * r * r
            c = value - before * l - after * r
            b = c * (left_pole + right_pole) + s1 + s2
            e = c * left_pole * right_pole + s1 * right_pole + s2 * left_pole
            q = (b + np.copysign(np.sqrt(np.maximum(b * b - 4 * c * e, 0)), b)) / 2
            one, two = q / c, e / q
            step = np.where((one > low) & (one < high), one, two)
            step = np.where(inner, step, left_pole + before * l * l / (value - before * l))
        middle = (low + high) / 2
        moved = np.where((step > low) & (step < high), step, middle)
        moved = np.where(done, x, moved)
        if (moved == x).all():
            break
        x = moved
    return delta - x


def updated(values: np.ndarray, vectors: np.ndarray, along: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of a matrix plus weight * outer(along, along); eigenvalues ascend, weight is not negative."""
    z = vectors.T @ along
    size = weight * float(z @ z)
    if not size > 0:
        return values, vectors
    slack = 8 * _EPS * max(abs(values[0]), abs(values[-1]), size)
    touched = np.abs(z) * weight * np.sqrt(float(z @ z)) > slack
    at = np.flatnonzero(touched)
    close = np.flatnonzero(np.diff(values[at]) <= np.sqrt(slack / (len(values) + 1)) * 1e-2 + slack) if len(at) > 1 else []
    if len(close):
        values, vectors, at = _rotated(values, vectors, z, at, slack)
    if not len(at):
        return values, vectors
    d, part = values[at], z[at]
    away = secular_roots(d, weight * part * part)
    # the weights whose exact roots these are give orthogonal vectors
    m = len(at)
    i, j = np.arange(m)[:, None], np.arange(m)
    other = d[np.minimum(np.where(j < i, j, j + 1), m - 1)] - d[:, None]
    other = np.where(j == m - 1, np.where(i == m - 1, 1.0, other), other)
    ratio = -away / np.where(j < m - 1, np.where(other == 0, 1.0, other), 1.0)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(part)
    turn = exact[:, None] / away
    turn /= np.sqrt((turn * turn).sum(axis=0))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[at] = d - away[np.arange(m), np.arange(m)]
    new_vectors[:, at] = vectors[:, at] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


def _rotated(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, at: np.ndarray, slack: float):
    """Turn the vectors of (nearly) equal eigenvalues so that only one of them is touched; ``z`` is changed in place."""
    values, vectors, kept = values.copy(), vectors.copy(), [at[0]]
    for b in at[1:]:
        a = kept[-1]
        length = np.hypot(z[a], z[b])
        c, s = z[b] / length, z[a] / length
        if abs((values[b] - values[a]) * c * s) > slack:
            kept.append(b)
            continue
        z[a], z[b] = 0.0, length
        one, two = vectors[:, a].copy(), vectors[:, b].copy()
        vectors[:, a], vectors[:, b] = c * one - s * two, s * one + c * two
        values[a], values[b] = values[a] * c * c + values[b] * s * s, values[a] * s * s + values[b] * c * c
        kept[-1] = b
    return values, vectors, np.array(kept)


@dataclass
class Spectrum:
    """Rows seen, their exact sums, their mean, and the spectrum of their scatter matrix."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims, object), np.zeros(dims), np.zeros(dims), np.eye(dims))

    def take(self, rows: np.ndarray) -> None:
        """Take in rows of whole numbers; equal ones are one update."""
        self.sums = self.sums + rows.sum(axis=0).astype(object)  # fits: some thousand rows of entries below 2 ** 47
        for row, times in zip(*np.unique(rows, axis=0, return_counts=True)):
            self._add(row.astype(float) - OFFSET, int(times))

    def _add(self, point: np.ndarray, times: int) -> None:
        """One centred update for a point that stands ``times`` times."""
        away = point - self.mean
        n = self.n + times
        if self.n:
            self.values, self.vectors = updated(self.values, self.vectors, away, self.n * times / n)
        self.mean = self.mean + away * (times / n)
        self.n = n

    def join(self, other: Spectrum) -> Spectrum:
        """The spectrum of both parts' rows, by successive updates with the other part's vectors."""
        if not other.n or not self.n:
            return self if self.n else other
        n, away = self.n + other.n, other.mean - self.mean
        values, vectors = self.values, self.vectors
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                values, vectors = updated(values, vectors, vector, float(value))
        values, vectors = updated(values, vectors, away, self.n * other.n / n)
        return Spectrum(n, self.sums + other.sums, self.mean + away * (other.n / n), values, vectors)


# --- partial results on Spark ---

_SPECTRUM = "slot long, n long, sums array<string>, mean array<double>, values array<double>, vectors array<double>"
_MOMENTS = "slot long, n long, mean array<double>, scatter array<double>"


def _spectrum_row(slot: int, s: Spectrum) -> dict:
    return {"slot": slot, "n": s.n, "sums": list(map(str, s.sums)), "mean": s.mean.tolist(), "values": s.values.tolist(),
            "vectors": s.vectors.ravel().tolist()}


def _spectrum_of(row: dict) -> Spectrum:
    dims = len(row["mean"])
    return Spectrum(row["n"], np.array(list(map(int, row["sums"])), object), np.array(row["mean"]), np.array(row["values"]),
                    np.array(row["vectors"]).reshape(dims, dims))


@dataclass
class Moments:
    """Rows seen, their mean and their scatter matrix."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def join(self, other: Moments) -> Moments:
        n = self.n + other.n
        away = other.mean - self.mean
        return Moments(n, self.mean + away * (other.n / n), self.scatter + other.scatter + np.outer(away, away) * (self.n * other.n / n))


def _moments_row(slot: int, s: Moments) -> dict:
    return {"slot": slot, "n": s.n, "mean": s.mean.tolist(), "scatter": s.scatter.ravel().tolist()}


def _moments_of(row: dict) -> Moments:
    dims = len(row["mean"])
    return Moments(row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(dims, dims))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _combined(parts: DataFrame, ddl: str, load: Callable, dump: Callable, label: str) -> dict | None:
    """One row for all: rounds that join FAN_IN neighbouring partial results each.

    A partial result is as large as a few square matrices of the dimension; only the last one
    goes to the driver.
    """
    parts = materialize(parts, label)
    most = parts.agg(F.max("slot")).first()[0]
    if most is None:
        return None

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["slot"])
        whole = reduce(lambda a, b: a.join(b), map(load, rows))
        return pa.Table.from_pylist([dump(rows[0]["slot"] // FAN_IN, whole)], _arrow(ddl))

    while most > 0:
        groups = most // FAN_IN + 1
        parts = parts.withColumn("to", F.floor(F.col("slot") / FAN_IN)).repartition(groups, "to").groupBy("to").applyInArrow(lambda t: join(t), ddl)
        most //= FAN_IN
    return parts.first().asDict()


def _matrix(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _fit(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spectrum.empty(dims)
        for batch in batches:
            seen.take(_matrix(batch, 0, dims))
        if seen.n:
            yield pa.RecordBatch.from_pylist([_spectrum_row(TaskContext.get().partitionId(), seen)], _arrow(_SPECTRUM))

    return run


def _project(dims: int, centred: Callable[[np.ndarray], np.ndarray], basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            if batch.num_rows:
                points = centred(_matrix(batch, 0, dims)) @ basis
                mean = points.mean(axis=0)
                own = Moments(len(points), mean, (points - mean).T @ (points - mean))
                seen = own if seen is None else seen.join(own)
        if seen is not None:
            yield pa.RecordBatch.from_pylist([_moments_row(TaskContext.get().partitionId(), seen)], _arrow(_MOMENTS))

    return run


# --- the operator ---

def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * c) + OFFSET for each entry c of a valid vector, null for other vectors."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(c))
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fits, entries)


@dataclass
class Whitening:
    """Components by falling eigenvalue over ``n`` rows with the exact sums ``sums``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows of whole numbers less their mean; the whole part of the mean is taken off exactly."""
        n = self.n
        whole = np.array([s // n for s in self.sums], np.int64)
        rest = np.array([s % n / n for s in self.sums])
        return lambda rows: (rows - whole).astype(float) - rest

    def deviations(self) -> Callable[[np.ndarray], list]:
        """The sum of (n * x - sums) ** 2 of each row, exact; None where it doesn't fit a long."""
        n = self.n
        whole, rest = [s // n for s in self.sums], [s % n for s in self.sums]
        wholes, rests = np.array(whole, np.int64), np.array(rest, np.int64)

        def of(rows: np.ndarray) -> list:
            away = rows - wholes
            most = n * (int(np.abs(away).max(initial=0)) + 1)
            if most * most * rows.shape[1] < 1 << 63:
                return ((away * n - rests) ** 2).sum(axis=1).tolist()
            sums = ((away.astype(object) * n - rests.astype(object)) ** 2).sum(axis=1)
            return [int(s) if s < 1 << 63 else None for s in sums]

        return of


def _kept(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows (key, x) with valid vectors of the commonest length (of equally common ones, the longest)."""
    rows = df.select(df[key].alias("key"), whole_numbers(df[vector]).alias("x")).where("x IS NOT NULL")
    length = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "dims")).alias("top")).first()["top"]
    dims = length["dims"] if length else 0
    return rows.where(F.size("x") == dims), dims


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (key, x); None for no rows. Directions without variance are no components."""
    found = _combined(rows.select("x").mapInArrow(_fit(dims), _SPECTRUM), _SPECTRUM, _spectrum_of, _spectrum_row, "spectra")
    if found is None:
        return None
    rough = _spectrum_of(found)
    basis = np.linalg.qr(rough.vectors)[0]
    w = Whitening(rough.n, [int(s) for s in rough.sums], rough.values, basis, 0.0)

    def scatter(onto: np.ndarray) -> np.ndarray:
        got = _combined(rows.select("x").mapInArrow(_project(dims, w.centred(), onto), _MOMENTS), _MOMENTS, _moments_of, _moments_row, "moments")
        return _moments_of(got).scatter / w.n

    values, turn = np.linalg.eigh(scatter(basis))
    w.values, w.vectors, w.trace = values[::-1], basis @ turn[:, ::-1], float(values.sum())
    real = int((w.values > dims * _EPS * max(w.values[0], 0)).sum()) if w.values[0] > 0 else 0
    w.values, w.vectors = w.values[:min(real, components)], w.vectors[:, :min(real, components)]
    if len(w.values):
        w.identity_error = float(np.abs(scatter(w.vectors / np.sqrt(w.values)) - np.eye(len(w.values))).max())
    return w


def _output(w: Whitening, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centred, deviations = w.centred(), w.deviations()
        onto, k = w.vectors / np.sqrt(w.values), len(w.values)
        numbers, explained = np.arange(1, k + 1, dtype=np.int32), w.values / w.trace
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                rows, m = _matrix(part, 1, dims), part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(numbers, m)), pa.array(np.full(m * k, w.n)),
                    pa.array(deviations(rows), pa.int64()).take(each), pa.array((centred(rows) @ onto).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, w.identity_error))],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) for each valid row and component.

    Vectors that are null, empty, or hold an entry that is null, not finite or beyond ``LARGEST``
    are dropped, and so are those of another length than the commonest one. Repeated rows and null
    keys stay and count each. A deviation that doesn't fit a long is null. Without rows, or where
    all are equal, there is no component and so no row. Other columns are left out.
    """
    rows, dims = _kept(df, key, vector)
    columns = f"key {dict(rows.dtypes)['key']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(rows, dims, components) if dims else None
    if w is None or not len(w.values):
        return df.sparkSession.createDataFrame([], columns).withColumnRenamed("key", key)
    return rows.mapInArrow(_output(w, dims), columns).withColumnRenamed("key", key)
