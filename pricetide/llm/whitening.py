"""Whitening of embeddings by their leading principal components.

Vectors are put on a grid of integers, so that equal vectors are equal and sums
are exact.  The model is fitted to each distinct vector once:

1. sums per dimension, exact, as partial sums of tasks;
2. the covariance, centred before multiplying: a task adds up the products of
   its vectors' distances from the mean, and the tasks' matrices meet in a
   partial aggregate by matrix entry;
3. the driver holds the covariance, whose size is the square of the dimension
   whatever the number of rows.  Householder reflections make it tridiagonal,
   bisection on Sturm counts finds the leading eigenvalues, inverse iteration
   the eigenvectors; vectors of near eigenvalues are made orthogonal to one
   another in every round;
4. all rows are projected with the components, which travel with the plan.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 16
#: Grid steps per unit.
SCALE = 64
#: A component with less than this part of the largest variance is rounding and is left out.
LEAST_VARIANCE = 1e-10
#: Eigenvalues nearer than this part of the matrix's norm have their vectors made orthogonal.
NEAR = 1e-3
ROUNDS = 6
EPS = float(np.finfo(np.float64).eps)
LARGEST = 2**62


@dataclass
class Whitening:
    """What ``whiten`` needs: ``n`` distinct vectors, sums on the grid, components as rows with their variances."""

    n: int = 0
    size: int = 0
    sums: list[int] = field(default_factory=list)
    trace: float = 0.0
    variances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    directions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        """Columns: components over the root of their variance."""
        return (self.directions / np.sqrt(self.variances)[:, None]).T


def householder(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors whose reflections make a symmetric matrix tridiagonal."""
    a, mirrors = matrix.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        if not np.any(v[1:]):
            mirrors.append(np.zeros_like(v))
            continue
        v /= np.abs(v).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        edge = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = edge
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def reflected(vectors: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """Columns of the tridiagonal matrix's space in that of the original one."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        part = out[k + 1 :]
        part -= 2 * np.outer(mirrors[k], mirrors[k] @ part)
    return out


def sturm_counts(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: the negative terms of the Sturm sequence."""
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for d, square in zip(diagonal[1:], squares, strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - at - square / q
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of a symmetric tridiagonal matrix, falling, by bisection."""
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    norm = max(float(np.max(np.abs(diagonal) + reach)), np.finfo(np.float64).tiny)
    low = np.full(k, np.min(diagonal - reach) - EPS * norm * len(diagonal))
    high = np.full(k, np.max(diagonal + reach) + EPS * norm * len(diagonal))
    least = max(EPS * EPS * norm, np.finfo(np.float64).tiny)
    # the i-th largest has len - i eigenvalues below or at it
    wanted = len(diagonal) - np.arange(1, k + 1)
    for _ in range(200):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= EPS * EPS * norm)):
            break
        under = sturm_counts(diagonal, off * off, middle, least) > wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, at: float, least: float):
    """Solve ``(T - at) x = y`` by elimination with row exchanges; vanishing pivots become ``least``."""
    n = len(diagonal)
    main, upper, second = (diagonal - at).tolist(), [*off.tolist(), 0.0], [0.0] * n
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        under = float(off[i])
        if abs(under) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / under
            below = (main[i + 1], upper[i + 1])
            held = upper[i]
            main[i], upper[i], second[i] = under, below[0], below[1]
            main[i + 1], upper[i + 1] = held - factor[i] * below[0], -factor[i] * below[1]
        else:
            if abs(main[i]) < least:
                main[i] = least
            factor[i] = under / main[i]
            main[i + 1] -= factor[i] * upper[i]
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(right: np.ndarray) -> np.ndarray:
        y = right.tolist()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
            else:
                y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            more = upper[i] * y[i + 1] if i + 1 < n else 0.0
            if i + 2 < n:
                more += second[i] * y[i + 2]
            y[i] = (y[i] - more) / main[i]
        return np.array(y)

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, for eigenvalues in falling order."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    norm = max(float(np.max(np.abs(diagonal) + reach)), np.finfo(np.float64).tiny)
    least = max(EPS * norm, np.finfo(np.float64).tiny)
    draw, out = np.random.default_rng(7), np.zeros((n, len(values)))
    cluster, last = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > NEAR * norm:
            cluster = k
        # equal eigenvalues are set apart by rounding, so that the solutions differ
        last = min(float(value), last - 4 * least) if k > cluster else float(value)
        solve, x = _solver(diagonal, off, last, least), draw.standard_normal(n)
        mates = out[:, cluster:k]
        for _ in range(ROUNDS):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x -= mates @ (mates.T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    scale = float(np.abs(matrix).max()) if matrix.size else 0.0
    k = min(k, len(matrix))
    if not scale or not k:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, off, mirrors = householder(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = reflected(tridiagonal_vectors(diagonal, off, values), mirrors).T
    return values * scale, vectors / np.linalg.norm(vectors, axis=1)[:, None]


def on_grid(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)``: ``floor(scale * component)`` of rows without null or non-finite components.

    A component that has no place among 64-bit integers counts as non-finite, and
    an empty vector as null.  Vectors of another length than the most frequent
    one (the smaller of equally frequent ones) cannot be projected and are left out.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("size(v) > 0")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale))
    rows = rows.where(sound).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["n"] if sizes else 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0), len(batch.column(0)[0]))
        safe = float(np.abs(x).max()) * len(x) < LARGEST
        part = [int(s) for s in (x if safe else x.astype(object)).sum(axis=0)]
        total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        rows += len(x)
    if rows:
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(-1, len(total)), pa.int32()), "s": pa.array([str(rows), *map(str, total)])}
        )


def _products(shift: np.ndarray, turn: np.ndarray | None):
    """Per task, the sums of products of all pairs of columns of ``(x - shift) turn``; column -1 is all ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _matrix(batch.column(0), len(shift)) - shift
            c = c if turn is None else c @ turn
            c = np.hstack([np.ones((len(c), 1)), c])
            total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            i, j = np.triu_indices(len(total))
            for low in range(0, len(i), 65_536):
                part = slice(low, low + 65_536)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), pa.array(total[i[part], j[part]])],
                    names=["i", "j", "s"],
                )

    return run


def covariance(points: DataFrame, n: int, shift: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Of ``(x - shift) turn`` over all rows of ``points(x)``, divisor ``n``.

    ``shift`` is the mean, so what is multiplied is centred; what rounding leaves
    of a mean is taken off.
    """
    added = points.select("x").mapInArrow(_products(shift, turn), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    size = 1 + (len(shift) if turn is None else turn.shape[1])
    out = np.zeros((size, size))
    for row in added.collect():  # the square of the dimension, not of the rows
        out[row.i, row.j] = out[row.j, row.i] = row.s
    rest = out[0, 1:] / n
    return out[1:, 1:] / n - np.outer(rest, rest)


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """The model of the distinct grid vectors of ``vectors(vec_id, embedding)``; nothing usable gives an empty one."""
    points = keep(on_grid(vectors, scale).select("x").distinct())
    counted = points.mapInArrow(_sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = {r.i: int(r.s) for r in counted.collect()}
    if not sums:
        return Whitening()
    n = sums.pop(-1)
    model = Whitening(n=n, size=len(sums), sums=[sums[i] for i in range(len(sums))])
    spread = covariance(points, n, model.mean)
    model.trace = float(np.trace(spread))
    values, directions = leading_components(spread, components)
    some = values > LEAST_VARIANCE * values[0] if len(values) else np.zeros(0, bool)
    model.variances, model.directions = values[some], directions[some]
    if some.any():
        white = covariance(points, n, model.mean, model.projection)
        model.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return model


def _whitened(model: Whitening):
    mean, projection, k = model.mean, model.projection, len(model.variances)
    explained, n, sums = model.variances / model.trace, model.n, model.sums

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * int(np.abs(x).max()) + max(map(abs, sums))
        if most * most * len(sums) < 2 * LARGEST:
            far = n * x - np.array(sums, np.int64)
            return (far * far).sum(axis=1).tolist()
        far = n * x.astype(object) - np.array(sums, object)
        return [d if d < 2 * LARGEST else None for d in map(int, (far * far).sum(axis=1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4_096):
                part = batch.slice(start, 4_096)
                x, m = _matrix(part.column(1), len(sums)), part.num_rows
                white = (x - mean) @ projection
                rows = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(x), pa.int64()).take(pa.array(rows)),
                        pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, model: Whitening, scale: int = SCALE) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per usable row and component.

    ``deviation`` is the exact sum over dimensions of ``(n * x - sum)^2``, null where a
    long cannot hold it.  Rows with equal vectors or ids, or a null id, are each
    returned.  A direction in which the vectors do not vary is no component, so
    a table of one distinct vector, or of none, gives no rows.  Other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    points = on_grid(vectors, scale)
    if not len(model.variances):
        return points.sparkSession.createDataFrame([], schema)
    return points.mapInArrow(_whitened(model), schema)
