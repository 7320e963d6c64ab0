"""Whitening of embeddings: pivoted Cholesky of the scatter, then one-sided Jacobi.

Vectors become whole numbers, so the sums and the scatter are exact and do not depend on how
Spark cuts or repeats the work. The scatter is centred before multiplying: each partition
subtracts the mean, rounded to whole numbers, and the rest of the mean (at most one half)
is taken out exactly afterwards.

The driver holds matrices of dimension by dimension, never vectors. There the covariance
is factored by Cholesky with pivoting, which also finds the rank, and Jacobi rotations
make the columns of the triangular factor orthogonal. For ``V = L L'`` and a rotation
``W``, the columns of ``L W`` are then the eigenvectors times the roots of the eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.text import staged

COMPONENTS = 16
#: A component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers up to here are exact as doubles, and far from the end of 64 bits.
EXACT, LIMIT = 1 << 53, 1 << 62
ROTATED = 1e-15
SWEEPS = 60


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is not null and has only finite components.

    All have the length of the longest; what a shorter vector lacks counts as component zero.
    Components of 2**62 / 64 and more raise.
    """
    raw = F.col("embedding")
    fine = raw.isNotNull() & ~F.exists(
        raw, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    )
    scaled = F.transform(raw, lambda c: F.when(
        F.abs(c.cast("double")) < LIMIT / SCALE, F.floor(c.cast("double") * SCALE) + SHIFT
    ).otherwise(F.raise_error(F.lit("component too large to whiten")).cast("long")))
    rows = staged(embeddings.filter(fine).select("vec_id", scaled.alias("x")), "whole-vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    lacking = F.lit(width) - F.size("x")
    padded = F.when(
        lacking > 0, F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), lacking))
    ).otherwise(F.col("x"))
    return rows.select("vec_id", padded.alias("x"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _bound(values: np.ndarray) -> int:
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))


def _scatter(y: np.ndarray) -> np.ndarray:
    """Exact sums of products, as Python integers."""
    if _bound(y) ** 2 * len(y) < EXACT:
        y = y.astype(np.float64)  # every partial sum is a whole number that doubles hold
        return (y.T @ y).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _added_up(vectors: DataFrame, terms) -> dict[int, int]:
    """Exact sums over all rows of what ``terms`` makes of a matrix of rows: one per place."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            if part.num_rows:
                new = terms(_matrix(part.column(0), part.num_rows))
                total = new if total is None else total + new
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            places = pa.array(np.arange(len(total)))
            yield pa.RecordBatch.from_arrays([places, values], ["place", "value"])

    partial = vectors.select("x").mapInArrow(batches, "place long, value decimal(38,0)")
    summed = partial.groupBy("place").agg(F.sum("value").alias("value"))
    return {r["place"]: int(r["value"]) for r in summed.collect()}


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``L`` of full column rank with ``L L' = matrix``; its rows keep the matrix's order."""
    rest = matrix.astype(np.float64).copy()
    size = len(rest)
    factor = np.zeros((size, size))
    pivots: list[int] = []
    least = size * np.finfo(float).eps * np.diag(rest).max(initial=0.0)
    for step in range(size):
        diagonal = np.diag(rest).copy()
        diagonal[pivots] = -np.inf
        pivot = int(diagonal.argmax())
        if diagonal[pivot] <= least:
            return factor[:, :step]
        column = rest[:, pivot] / np.sqrt(diagonal[pivot])
        column[pivots] = 0.0
        factor[:, step] = column
        rest -= np.outer(column, column)
        pivots.append(pivot)
    return factor


def _rounds(count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns, in rounds of pairs that have no column in common."""
    ring = list(range(count + count % 2))
    found = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [
            (a, b) for a, b in zip(ring[:half], ring[:half - 1:-1]) if max(a, b) < count
        ]
        found.append((np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return found


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of ``factor factor'``, largest first.

    Plane rotations from the right until all columns are orthogonal to each other.
    """
    columns = factor.T.copy()  # a row per column, so that rotations work on whole rows
    rounds = _rounds(len(columns)) if len(columns) > 1 else []
    for _ in range(SWEEPS):
        largest = 0.0
        for p, q in rounds:
            left, right = columns[p], columns[q]
            a, b = (left ** 2).sum(axis=1), (right ** 2).sum(axis=1)
            c = (left * right).sum(axis=1)
            cosine = np.abs(c) / np.sqrt(a * b)
            largest = max(largest, float(cosine.max(initial=0.0)))
            turn = cosine > ROTATED
            if not turn.any():
                continue
            zeta = (b[turn] - a[turn]) / (2 * c[turn])
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, tangent)
            cos, sin = cos[:, None], (cos * tangent)[:, None]
            columns[p[turn]] = cos * left[turn] - sin * right[turn]
            columns[q[turn]] = sin * left[turn] + cos * right[turn]
        if largest <= 4 * ROTATED:
            break
    norms = np.sqrt((columns ** 2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, (columns[order] / norms[order][:, None]).T


@dataclass
class Whitening:
    """What the fit list says: its size, exact sums and the leading components."""

    n: int
    center: np.ndarray
    #: Sums of what remains after the centre is subtracted.
    rest: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        y = x - self.center
        if (_bound(y) * self.n + _bound(self.rest)) < LIMIT:
            return self.n * y - self.rest.astype(np.int64)
        return self.n * y.astype(object) - self.rest

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        away = (centred / self.n).astype(np.float64)
        return away @ (self.components / np.sqrt(self.eigenvalues))


def _deviation(centred: np.ndarray) -> np.ndarray:
    if _bound(centred) ** 2 * centred.shape[1] < LIMIT:
        return (centred ** 2).sum(axis=1)
    return (centred.astype(object) ** 2).sum(axis=1)  # raises later if 64 bits do not hold it


def fit(vectors: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors ``x``; none without vectors or without spread."""
    n = vectors.count()
    if not n:
        return None
    sums = _added_up(vectors, lambda x: x.astype(object).sum(axis=0))
    total = [sums[i] for i in range(len(sums))]
    center = np.array([round(s / n) for s in total], np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(total, center)], object)
    upper = np.triu_indices(len(center))
    products = _added_up(vectors, lambda x: _scatter(x - center)[upper])
    covariance = np.zeros((len(center), len(center)))
    for place, (i, j) in enumerate(zip(*upper)):
        exact = n * products[place] - rest[i] * rest[j]
        covariance[i, j] = covariance[j, i] = exact / (n * n)
    eigenvalues, components = jacobi(pivoted_cholesky(covariance))
    if not len(eigenvalues):
        return None
    return Whitening(
        n, center, rest, eigenvalues[:count], components[:, :count], float(np.trace(covariance))
    )


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry, in absolute value, of the whitened vectors' covariance minus the identity."""
    size = len(model.eigenvalues)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + size * size)
        for part in parts:
            if part.num_rows:
                w = model.whitened(model.centred(_matrix(part.column(0), part.num_rows)))
                total += np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"]
        )

    rows = vectors.select("x").mapInArrow(batches, "place long, value double")
    sums = {r["place"]: r["value"] for r in rows.groupBy("place").agg(
        F.sum("value").alias("value")).collect()}
    mean = np.array([sums[i] for i in range(size)]) / model.n
    second = np.array([sums[size + i] for i in range(size * size)]).reshape(size, size) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(size)).max())


RESULT = "component int, deviation long, whitened double, explained double"


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    A row for each row of ``embeddings`` with a finite vector and each of the ``count`` leading
    components. The components are fitted on the distinct vectors, so copies do not weigh more;
    ids that repeat or are null keep their rows. Components without spread (beyond the
    rank) have no rows; an empty table, or one with a single distinct vector, gives
    an empty result. Other columns are not looked at. A ``deviation`` over 64 bits raises.
    """
    vectors = whole_vectors(embeddings)
    distinct = staged(vectors.select("x").distinct(), "fit-list")
    model = fit(distinct, count)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if model is None:
        empty = vectors.select("vec_id").limit(0)
        nulls: list[Column] = [
            F.lit(None).cast(t).alias(c) for c, t in (
                ("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"),
                ("explained", "double"), ("identity_error", "double"))
        ]
        return empty.select("vec_id", *nulls)
    error = identity_error(distinct, model)
    size = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.num_rows
            if not rows:
                continue
            centred = model.centred(_matrix(part.column(1), rows))
            ids = part.column(0).take(pa.array(np.repeat(np.arange(rows), size)))
            deviation = pa.array(_deviation(centred).tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), rows)),
                 deviation.take(pa.array(np.repeat(np.arange(rows), size))),
                 pa.array(model.whitened(centred).ravel()), pa.array(np.tile(explained, rows))],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    found = vectors.select("vec_id", "x").mapInArrow(batches, f"vec_id {kind}, {RESULT}")
    return found.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        "explained", F.lit(error).alias("identity_error"),
    )
