"""Whitening of vectors by shifted CholeskyQR.

Components become whole numbers first, ``x = floor(64 c) + 1000000``, so that sums and deviations are exact. The centred rows are
never stored: every pass reads the vectors again, subtracts the mean, solves against the triangular factors so far, and adds up the
Gram matrix of what it gets. The first factor comes from a shifted Gram matrix, which has a Cholesky factor whatever the condition of
the rows; passes go on until the rows are orthonormal. The composed factor holds all of the rows but a rotation, so its
singular values and right vectors are theirs. A task keeps one matrix of the vector length; tasks' matrices are added by row.

Defined results: null vectors and those with null or non-finite entries, or with entries beyond ``ENTRY``, are left out; of the rest
vectors of the most frequent length take part, of equally frequent ones the shortest. Null and repeated ids come back as given,
repeated rows count as often as they occur. Directions in which all vectors agree can't be whitened: there are as many components as
the vectors span dimensions, so a single vector or an empty table gives no rows. A ``deviation`` beyond 64 bits is null. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesight.llm.vectors import matrix, same_length

SCALE, OFFSET = 64, 1_000_000
ENTRY = float(1 << 24)  # the greatest entry taken, so that n * x fits into 64 bits for four billion vectors
COMPONENTS = 32
PASSES = 8  # rows of full rank need three
ORTHONORMAL = 1e-11
LEAST = 1e-13  # eigenvalues below this part of the greatest are zero

OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                 ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whole(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


def added_rows(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Per row number the sum of the arrays that tasks made, added where the rows meet; only the sums reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = row.values.to_numpy(zero_copy_only=False)
                sums[at] = sums[at] + values if at in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], parts_type)], names=["at", "part"])

    parts_type = pa.list_(pa.int64() if kind == "long" else pa.float64())
    return {r.at: np.array(r.part) for r in parts.repartition("at").mapInArrow(add, f"at int, part array<{kind}>").collect()}


def sums_of(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sums of their whole entries."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + whole(matrix(batch.column(0))).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([[n], total.tolist()], pa.list_(pa.int64()))], names=["at", "part"])

    sums = added_rows(vectors.select("vector").mapInArrow(part, "at int, part array<long>"), "long")
    return (int(sums[0][0]), sums[1]) if sums else (0, np.zeros(0, np.int64))


def centred(entries: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n``, from the exact ``n x - S``."""
    return (n * whole(entries) - sums) / n


def gram(vectors: DataFrame, n: int, sums: np.ndarray, apply) -> np.ndarray:
    """The sum over all vectors of the outer products of ``apply(centred rows)``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                q = apply(centred(matrix(batch.column(0)), n, sums))
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["at", "part"])

    rows = added_rows(vectors.select("vector").mapInArrow(part, "at int, part array<double>"), "double")
    return np.array([rows[k] for k in range(len(rows))])


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, by substitution column by column."""
    q = np.empty((len(r), len(rows)))
    for j in range(len(r)):
        q[j] = (rows[:, j] - r[:j, j] @ q[:j]) / r[j, j]
    return q.T


def solved(factors: list[np.ndarray]):
    """A function that solves rows against upper triangular factors, first to last."""

    def apply(rows: np.ndarray) -> np.ndarray:
        for r in factors:
            rows = triangular_solve(rows, r)
        return rows

    return apply


def shifted_factor(g: np.ndarray, n: int) -> np.ndarray:
    """The Cholesky factor of a Gram matrix, of a shifted one where rounding may have cost it its definiteness."""
    d = len(g)
    shift = 11 * (d * n + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(g, 2)
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def components(vectors: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of the covariance, falling, with their unit vectors as columns, and its trace."""
    d = len(sums)
    factors: list[np.ndarray] = []
    g = gram(vectors, n, sums, solved(factors))
    if not g.any():
        return np.zeros(0), np.zeros((d, 0)), 0.0
    for _ in range(PASSES):
        # A Gram matrix near the identity needs no shift; its rows are orthonormal after one more solve.
        near = factors and np.abs(g - np.eye(d)).max() < 0.1
        factors.append(np.linalg.cholesky(g).T if near else shifted_factor(g, n))
        before, g = g, gram(vectors, n, sums, solved(factors))
        values = np.linalg.eigvalsh(g)
        # Of rows without full rank, some directions stay at zero while the others reach one.
        if np.minimum(np.abs(values - 1), np.abs(values)).max() < ORTHONORMAL or np.abs(g - before).max() < ORTHONORMAL:
            break
    composed = np.eye(d)
    for r in factors:
        composed = r @ composed
    # What the last rows lack to be orthonormal; nothing but rounding where they have full rank.
    values, axes = np.linalg.eigh((g + g.T) / 2)
    composed = (np.sqrt(np.maximum(values, 0))[:, None] * axes.T) @ composed
    _, singular, right = np.linalg.svd(composed)
    e = singular ** 2 / n
    kept = e > LEAST * e[0]
    return e[kept], right[kept].T, float(e.sum())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: ``(id, component, n, deviation, whitened, explained, identity_error)``."""
    entries = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), entries.alias("vector"))
    plain = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= ENTRY))
    rows = same_length(rows.where(F.coalesce(F.col("vector").isNotNull() & (F.size("vector") > 0) & plain, F.lit(False))))
    n, sums = sums_of(rows)
    e, axes, trace = components(rows, n, sums) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    e, axes = e[:most], axes[:, :most]
    k = len(e)
    project = axes / np.sqrt(e)
    error = float(np.abs(gram(rows, n, sums, lambda x: x @ project) / n - np.eye(k)).max()) if k else 0.0
    explained = e / trace if k else e

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact sums of squares: in 64 bits where they surely fit, else in Python's own numbers."""
        moved = n * whole(x) - sums
        if (moved.astype(float) ** 2).sum(1).max() < 2.0 ** 62:
            return (moved ** 2).sum(1).tolist()
        exact = [sum(v * v for v in row) for row in moved.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            x = matrix(batch.column(1))
            deviation = pa.array(deviations(x), pa.int64())
            every = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                deviation.take(pa.array(every)), pa.array((centred(x, n, sums) @ project).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))], schema=OUT)

    return rows.mapInArrow(emit, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("vec_id", id_col)
