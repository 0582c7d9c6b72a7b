"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Spark sums the vectors and the scatter of the centred vectors; what reaches the driver is
one number per dimension and one per pair of dimensions, whatever the number of rows. There
the scatter is factored by Cholesky with diagonal pivoting, and Jacobi rotations are applied
to the columns of the triangular factor until all are orthogonal: their squared norms are
the eigenvalues, the normalised columns the components. Tasks then project their rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the integer grid: an entry c becomes floor(SCALE * c) + OFFSET.
SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Components whose eigenvalue is below this share of the largest are rounding noise.
LEAST_SHARE = 1e-10
#: Entries beyond it can't be told apart as doubles.
MOST_ENTRY = 2**52
MOST_LONG = 2**63 - 1


@dataclasses.dataclass(frozen=True)
class Whitening:
    """``rows`` fitted, exact ``sums`` per dimension, ``components`` (a column each), their eigenvalues, the trace."""

    rows: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def pivoted_cholesky(matrix: np.ndarray, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``matrix[order][:, order] = L @ L.T``; L has as many columns as the matrix has rank."""
    size = len(matrix)
    order, left = np.arange(size), np.diag(matrix).astype(np.float64).copy()
    factor = np.zeros((size, size))
    least = tolerance * size * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= least:
            return factor[:, :k], order
        for rows in (order, left, factor):
            rows[[k, p]] = rows[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        below = matrix[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]
        factor[k + 1 :, k] = below / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def one_sided_jacobi(factor: np.ndarray, tolerance: float = 1e-15, most_sweeps: int = 60) -> np.ndarray:
    """``factor @ Q`` for a rotation Q that makes its columns orthogonal.

    A sweep meets every pair of columns once; pairs are dealt as in a round robin, so that
    the rotations of one step touch different columns and are done together.
    """
    rotated = factor.T.copy()  # one row per column
    seats = np.arange(len(rotated) + len(rotated) % 2)
    for _ in range(most_sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            i, j = seats[:half], seats[half:][::-1]
            met = (i < len(rotated)) & (j < len(rotated))  # the empty seat of an odd number
            i, j = i[met], j[met]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            a, b = rotated[i], rotated[j]
            aa, bb, ab = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
            size = np.sqrt(aa * bb)
            off = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > tolerance
            if not turn.any():
                continue
            i, j, a, b, aa, bb, ab = (x[turn] for x in (i, j, a, b, aa, bb, ab))
            zeta = (bb - aa) / (2 * ab)
            tan = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = (1 / np.hypot(1.0, tan))[:, None]
            sin = cos * tan[:, None]
            rotated[i], rotated[j] = cos * a - sin * b, sin * a + cos * b
        if worst <= len(factor) * tolerance:
            return rotated.T
    raise ArithmeticError(f"columns not orthogonal after {most_sweeps} sweeps")


def principal_axes(scatter: np.ndarray, rows: int, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, eigenvalues) of ``scatter / rows``, largest first; signs make the largest entry positive."""
    factor, order = pivoted_cholesky(scatter)
    rotated = one_sided_jacobi(factor)
    norms = np.linalg.norm(rotated, axis=0)
    ranked = np.argsort(-norms, kind="stable")
    values = norms[ranked] ** 2 / rows
    ranked = ranked[values > LEAST_SHARE * values.max(initial=0.0)][:components]
    axes = np.empty((len(scatter), len(ranked)))
    axes[order] = rotated[:, ranked] / norms[ranked]
    top = axes[np.abs(axes).argmax(axis=0), np.arange(len(ranked))] if len(ranked) else np.ones(0)
    return axes * np.sign(top), norms[ranked] ** 2 / rows


def _usable(vector: Column) -> Column:
    """Vectors with entries, all of them finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def _grid(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Entries on the integer grid, one row per vector."""
    lengths = np.asarray(column.value_lengths())
    size = int(lengths[0]) if dims is None else dims
    if (lengths != size).any():
        raise ValueError("vector lengths differ")
    flat = np.floor(SCALE * np.asarray(column.flatten(), dtype=np.float64))
    if np.abs(flat).max(initial=0.0) > MOST_ENTRY:
        raise OverflowError("an entry is too large for the integer grid")
    return flat.astype(np.int64).reshape(len(column), size) + OFFSET


def _sums(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # Batches hold a bounded number of rows; halves keep their sums within a long.
                grid = _grid(batch.column(0))
                high, low = grid >> 26, grid & ((1 << 26) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.num_rows], pa.int64()), pa.array([high.sum(axis=0)], pa.list_(pa.int64())),
                     pa.array([low.sum(axis=0)], pa.list_(pa.int64()))],
                    names=["n", "high", "low"],
                )

    parts = vectors.mapInArrow(run, "n bigint, high array<bigint>, low array<bigint>")
    cells = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = cells.groupBy("dim").agg(F.sum("n").alias("n"), exact("s.high").alias("high"), exact("s.low").alias("low"))
    rows = sorted(found.collect(), key=lambda r: r.dim)  # one row per dimension
    if not rows:
        return 0, ()
    if len({r.n for r in rows}) > 1:
        raise ValueError("vector lengths differ")
    return rows[0].n, tuple((int(r.high) << 26) + int(r.low) for r in rows)


def _centred(grid: np.ndarray, rows: int, sums: tuple[int, ...]) -> np.ndarray:
    """``grid - sums / rows``: the whole part of the mean goes first, exactly, then its fraction."""
    whole = np.array([s // rows for s in sums], dtype=np.int64)
    rest = np.array([s % rows / rows for s in sums])
    return (grid - whole) - rest


def _deviations(grid: np.ndarray, rows: int, sums: tuple[int, ...]) -> list[int]:
    """Exact sums over the dimensions of ``(rows * x - sum) ** 2``."""
    whole = np.array([s // rows for s in sums], dtype=np.int64)
    rest = np.array([s % rows for s in sums], dtype=np.int64)
    near = grid - whole
    if (int(np.abs(near).max(initial=0)) * rows + rows) ** 2 * len(sums) <= MOST_LONG:
        return ((rows * near - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((rows * x - int(r)) ** 2 for x, r in zip(row, rest)) for row in near.tolist()]
    if max(exact) > MOST_LONG:
        raise OverflowError("a deviation does not fit a long")
    return exact


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all usable vectors of the table, by two passes over it."""
    usable = vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(_usable(F.col("v")))
    rows, sums = _sums(usable)
    if not rows:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            centred = _centred(_grid(batch.column(0), len(sums)), rows, sums)
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array([line[: i + 1] for i, line in enumerate(total)], pa.list_(pa.float64()))],
            names=["i", "line"],
        )

    cells = usable.mapInArrow(run, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "s"))
    scatter = np.zeros((len(sums), len(sums)))
    # One row per pair of dimensions.
    for i, j, s in cells.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        scatter[i, j] = scatter[j, i] = s
    axes, values = principal_axes(scatter, rows, components)
    return Whitening(rows, sums, axes, values, float(np.trace(scatter)) / rows)


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, deviation, whitened`` of every usable row: its projections over the root of the eigenvalues.

    Null vectors, empty ones and those with null or non-finite entries take no part;
    repeated rows stay repeated, a null id stays null, other columns are not read. Vectors of
    another length than the fitted ones, entries beyond 2^52 on the grid and deviations
    beyond a long are errors. ``whitened`` holds fewer than the asked components where the
    vectors span fewer dimensions (none where all are equal).
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(_usable(F.col("v")))
    out = f"`{id_col}` {kind}, deviation bigint, whitened array<double>"
    if not model.rows:
        return rows.limit(0).select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    project = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = _grid(batch.column(1), len(model.sums))
            scores = _centred(grid, model.rows, model.sums) @ project
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_deviations(grid, model.rows, model.sums), pa.int64()), pa.array(list(scores), pa.list_(pa.float64()))],
                names=[id_col, "deviation", "whitened"],
            )

    return rows.mapInArrow(run, out)


def identity_error(whitened: DataFrame, components: int) -> Column:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, as a scalar subquery.

    ``covar_pop`` updates centred products, so nothing is multiplied before it is centred.
    """
    part = [F.get("whitened", i) for i in range(components)]
    off = [F.abs(F.covar_pop(part[i], part[j]) - float(i == j)) for i in range(components) for j in range(i + 1)]
    return whitened.agg((F.greatest(*off) if len(off) > 1 else off[0]).alias("off")).scalar()


def whitened_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component.

    Components count from 1, by falling eigenvalue; ``explained`` is the eigenvalue over the
    trace. Edge cases are those of :func:`whiten`; an empty table, one vector, or only equal
    vectors have no component and give no rows.
    """
    model = fit_whitening(vectors, vector_col, components)
    scored = whiten(vectors, model, id_col, vector_col)
    found = len(model.eigenvalues)
    error = identity_error(scored, found) if found else F.lit(None).cast("double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    return scored.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.rows).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), error.alias("identity_error"),
    )
