"""Embedding whitening by incremental eigendecomposition.

Every distinct vector is one rank-one update of the eigendecomposition of the centred scatter matrix: the update's
direction is written in the present eigenvectors, entries that change nothing are deflated, and the other eigenvalues are
the roots of a secular equation. Tasks do so for their part of the vectors; two parts are put together by
further rank-one updates, one for each eigenpair of the second and one for the distance of the means, in a tree
of groups of ``FAN_IN``. The vectors found are a basis of the whole space; a last pass over all vectors gathers the covariance in
that basis, centred with the exact mean, and its eigenvectors give the components to double precision.

What reaches the driver is one matrix of the vectors' dimensions; sums of the entries are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import table
from tidemark.storage import dropped, written

SCALE = 256
COMPONENTS = 4
ROWS = 2048  # distinct vectors of a task; each costs one update of all eigenvectors
FAN_IN = 16
EPSILON = float(np.finfo(float).eps)
ROUNDS = 60  # of the secular equation, which needs about five; bisection alone would need these
NO_VARIANCE = 1e-12  # a component with less than this share of all variance has none


def roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)), one above each pole, and poles minus roots, by (root, pole).

    Poles ascend and differ, weights are positive. Each root is sought as a distance from the nearer of its two poles, by an
    interpolation by two poles that falls back to bisection, so the differences are accurate as well.
    """
    size = len(poles)
    here, last = np.arange(size), size - 1
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    half = (upper - poles) / 2
    at_half = 1 + (weights / (poles - (poles + half)[:, None])).sum(1)
    from_left = (at_half >= 0) | (here == last)
    apart = poles - np.where(from_left, poles, upper)[:, None]
    low = np.where(from_left, 0.0, -half)
    high = np.where(from_left, half, 0.0)
    if at_half[last] < 0:
        low[last], high[last] = half[last], 2 * half[last]
    x = (low + high) / 2
    # The function is taken as a constant and two poles: the two around the root, for the last root the two before it. The
    # nearer pole keeps its own weight, slope and value settle the rest; the root of that is the next try.
    first = np.minimum(here, max(last - 1, 0))
    second = np.minimum(first + 1, last)
    near = np.where(from_left & (here < last), first, second)
    far = first + second - near
    settled = np.zeros(size, bool)
    for _ in range(ROUNDS):
        gap = apart - x[:, None]
        share = weights / gap
        value, slope = 1 + share.sum(1), np.einsum("ij,ij->i", share, 1 / gap)
        high, low = np.where(value > 0, x, high), np.where(value > 0, low, x)
        one, two = gap[here, first], gap[here, second]
        to_near, to_far = gap[here, near], gap[here, far]
        constant = value - to_far * slope - (to_near - to_far) * share[here, near] / to_near
        linear, product = (one + two) * value - one * two * slope, one * two * value
        root = np.sqrt(np.abs(linear**2 - 4 * constant * product))
        root[last] = -root[last]
        with np.errstate(divide="ignore", invalid="ignore"):
            new = x + np.where((linear <= 0) ^ (here == last), (linear - root) / (2 * constant), 2 * product / (linear + root))
        # A root stays where it is once the step is lost in rounding, or the value in that of its terms.
        settled |= (np.abs(new - x) <= 4 * EPSILON * np.abs(x)) | (np.abs(value) <= 4 * EPSILON * (1 + np.abs(share).sum(1)))
        if settled.all():
            break
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        x = np.where(settled, x, new)
    gap = apart - x[:, None]
    return np.where(from_left, poles, upper) + x, gap


def updated(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors (columns) of ``V diag(values) V' + weight * direction direction'``."""
    share = vectors.T @ direction
    length = float(share @ share) * weight
    if not length > 0:
        return values, vectors
    tolerance = 8 * EPSILON * max(values[-1], length)
    # Equal eigenvalues: their vectors are turned so that one of them takes the whole share.
    close = np.flatnonzero(np.diff(values) <= tolerance)
    if len(close):
        vectors = vectors.copy()
        for run in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
            block = slice(run[0], run[-1] + 2)
            part = share[block].copy()
            norm = np.sqrt(part @ part)
            if norm > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(norm, part[-1])
                mirror /= np.sqrt(mirror @ mirror)
                vectors[:, block] -= 2 * np.outer(vectors[:, block] @ mirror, mirror)
                share[block] = 0
                share[block.stop - 1] = -np.copysign(norm, part[-1])
    active = np.abs(share) * np.sqrt(weight * length) > tolerance
    if not active.any():
        return values, vectors
    poles = values[active]
    found, gap = roots(poles, weight * share[active] ** 2)
    # The shares that have exactly these roots; with them the new vectors are orthogonal to the last bits.
    between = poles[:, None] - poles
    np.fill_diagonal(between, 1.0)
    exact = np.copysign(np.sqrt(np.abs((gap / between).prod(0))), share[active])
    turn = (exact / gap).T
    turn /= np.sqrt((turn**2).sum(0))
    values, vectors = values.copy(), vectors.copy()
    values[active], vectors[:, active] = found, vectors[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Eigendecomposition of the centred scatter matrix of ``n`` vectors, their mean and the exact sums of their entries."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.vectors = updated(self.values, self.vectors, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n
        self.sums = self.sums + x

    def join(self, other: Spectrum) -> None:
        """Take in what another part has found."""
        both, away = self.n + other.n, other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = updated(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = updated(self.values, self.vectors, away, self.n * other.n / both)
        self.mean = self.mean + away * (other.n / both)
        self.n, self.sums = both, self.sums + other.sums


SPECTRUM = "part long, n long, sums array<long>, mean array<double>, spectrum array<double>, vectors array<double>"


def _as_rows(part: int, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": [part], "n": [s.n], "sums": [s.sums.tolist()], "mean": [s.mean.tolist()], "spectrum": [s.values.tolist()],
        "vectors": [s.vectors.ravel().tolist()]})


def _of_rows(rows: pa.Table) -> Iterator[Spectrum]:
    for r in rows.to_pylist():
        yield Spectrum(r["n"], np.array(r["sums"], np.int64), np.array(r["mean"], float), np.array(r["spectrum"], float),
                       np.array(r["vectors"], float).reshape(len(r["mean"]), -1))


def gathered(parts: DataFrame, merge: Callable[[pa.Table], pa.RecordBatch]) -> dict:
    """The one row that is left when groups of ``FAN_IN`` rows (by ``part``) are merged again and again."""
    parts = written(parts, "parts")
    left = parts.count()

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([merge(rows.sort_by("part"))])

    while left > 1:
        merged = written(parts.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(joined, parts.schema), "parts")
        dropped(parts)
        parts, left = merged, merged.count()
    found = parts.first()
    dropped(parts)
    return found.asDict()


def entries(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Usable rows with ``x``, their entries as whole numbers, and the number of entries of the longest.

    Rows whose vector is null or holds a null, NaN or infinite entry go. Shorter vectors are filled with zeros.
    """
    usable = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE))
    rows = vectors.where(usable)
    sizes = rows.agg(F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most")).first()
    if sizes["most"] != sizes["least"]:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), sizes["most"] - F.size(column)))
    return rows.withColumn("x", x), sizes["most"] or 0


def _matrices(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for part in parts:
        if part.num_rows:
            yield part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


@dataclass
class Whitening:
    """What ``fitted`` found: vectors counted, exact sums, eigenvalues (falling) and unit components (rows)."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    error: float | None

    def project(self, x: Column, component: int) -> Column:
        """The whitened value of entries ``x``; null for a component without variance."""
        value = self.values[component]
        if not self.has_variance(component):
            return F.lit(None).cast("double")
        by = (self.components[component] / np.sqrt(value)).tolist()
        mean = [s / self.n for s in self.sums]
        return F.aggregate(F.zip_with(F.zip_with(x, table(mean, "array<double>"), lambda a, m: a - m), table(by, "array<double>"), lambda a, b: a * b),
                           F.lit(0.0), lambda total, y: total + y)

    def has_variance(self, component: int) -> bool:
        return bool(self.values[component] > NO_VARIANCE * self.values.sum())


def fitted(x: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of the covariance of the distinct ``x``; None without rows."""
    fit = written(x.select("x").distinct(), "vectors")
    n = fit.count()
    if not n or not size:
        return None
    spread = fit.repartition(-(-n // ROWS))

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(size)
        for rows in _matrices(parts, size):
            for row in rows:
                own.add(row)
        if own.n:
            yield _as_rows(TaskContext.get().partitionId(), own)

    def merge(rows: pa.Table) -> pa.RecordBatch:
        first, *others = _of_rows(rows)
        for other in others:
            first.join(other)
        return _as_rows(rows["part"][0].as_py(), first)

    whole = gathered(spread.mapInArrow(found, SPECTRUM), merge)
    basis = np.linalg.qr(np.array(whole["vectors"], float).reshape(size, size))[0]
    mean = np.array([s / n for s in whole["sums"]])
    scatter = _second_moments(spread, lambda rows: (rows - mean) @ basis, size)
    values, turn = np.linalg.eigh(scatter / n)
    order = np.argsort(values)[::-1]
    vectors = (basis @ turn[:, order]).T
    vectors *= np.where(vectors[np.arange(size), np.abs(vectors).argmax(1)] < 0, -1.0, 1.0)[:, None]
    result = Whitening(n, whole["sums"], np.maximum(values[order], 0.0), vectors, None)
    by = np.array([result.components[i] / np.sqrt(result.values[i]) for i in range(min(components, size)) if result.has_variance(i)])
    if len(by):
        result.error = _identity_error(spread, mean, by, n)
    dropped(fit)
    return result


def _second_moments(spread: DataFrame, project: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of the outer products of the projected rows."""
    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = 0.0, False
        for rows in _matrices(parts, size):
            y = project(rows)
            total, any_rows = total + y.T @ y, True
        if any_rows:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "moments": [total.ravel().tolist()]})

    def merge(rows: pa.Table) -> pa.RecordBatch:
        total = np.array(rows["moments"].to_pylist()).sum(0)
        return pa.RecordBatch.from_pydict({"part": [rows["part"][0].as_py()], "moments": [total.tolist()]})

    total = np.array(gathered(spread.mapInArrow(moments, "part long, moments array<double>"), merge)["moments"])
    return total.reshape(int(len(total) ** 0.5), -1)


def _identity_error(spread: DataFrame, mean: np.ndarray, by: np.ndarray, n: int) -> float:
    """Largest entry, without sign, of the covariance of the whitened fit list minus the identity.

    A constant 1 beside the whitened values gathers their sums, which centre them.
    """
    def whitened(rows: np.ndarray) -> np.ndarray:
        return np.column_stack([(rows - mean) @ by.T, np.ones(len(rows))])

    total = _second_moments(spread, whitened, by.shape[1]) / n
    centred = total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1])
    return float(np.abs(centred - np.eye(len(by))).max())


def whitened(vectors: DataFrame, key: str, column: str, components: int = COMPONENTS) -> DataFrame:
    """Each usable row projected on the first components: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows that repeat, or share a key, each have their rows, but count once towards the fit. Rows whose vector is null or has a
    null or non-finite entry are left out; shorter vectors are filled with zeros. There are as many components as the
    vectors have entries, if that is less. A component without variance has a null ``whitened`` and is left out of
    ``identity_error``, which is null if none has any; ``explained`` is null if nothing varies. Nothing is
    returned for a table without usable rows. ``deviation`` is exact; beyond 64 bits it raises an error. Other columns are not read.
    """
    rows, size = entries(vectors.select(key, column), column)
    fit = fitted(rows, size, components)
    schema = (f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    trace = float(fit.values.sum())
    away = F.zip_with("x", table(fit.sums, "array<bigint>"), lambda a, s: a * F.lit(fit.n).cast("long") - s)
    deviation = F.aggregate(away, F.lit(0).cast("long"), lambda total, d: total + d * d)
    parts = F.array(*[F.struct(F.lit(i + 1).alias("component"), fit.project(F.col("x"), i).alias("whitened"),
                               F.lit(float(fit.values[i]) / trace if trace > 0 else None).cast("double").alias("explained"))
                      for i in range(min(components, size))])
    found = rows.select(key, deviation.alias("deviation"), F.explode(parts).alias("part"))
    return found.select(key, "part.component", F.lit(fit.n).cast("long").alias("n"), "deviation", "part.whitened", "part.explained",
                        F.lit(fit.error).cast("double").alias("identity_error"))
