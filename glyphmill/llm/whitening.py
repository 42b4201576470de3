"""Whitening of embeddings by their leading principal components, found without a covariance matrix.

Block subspace iteration: each Spark pass takes a block Q of orthonormal columns to the tasks and brings back
Xᵀ(XQ) of the centred rows X, summed over tasks in two steps. Rayleigh-Ritz on the driver turns the block into Ritz
vectors, whose residuals say how good each of them is; QR of what the pass brought gives the next block. Passes go on
until the residuals of all components are at the level of rounding. How fast a block converges follows from its own Ritz
values; a block that would need many more passes is widened, to all dimensions at most, where one pass is exact.
The driver and the tasks hold matrices of dimension x block, whatever the number of rows.

Rows are integers, scaled and shifted, and each distinct row counts once; sums and distances are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from .common import cut, partitions

#: Scale and shift of a component before it is cut to an integer.
SCALE, SHIFT = 64, 1_000_000
#: Components asked for, columns of the first block beside them, and passes that a block gets before it is widened.
COMPONENTS, SPARE, PATIENCE = 16, 16, 6
#: A component is found when its residual is at most so much of the largest eigenvalue; an eigenvalue of at most as much is zero.
TOLERANCE = 256 * np.finfo(float).eps
#: Scaled components from here on are no longer exact in double precision.
EXACT = float(1 << 53)


def integers(v: Column) -> Column:
    """The vector as integers: floor(SCALE * c) + SHIFT of each component c, in double precision."""
    return F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of rows whose vector is finite throughout, of the commonest dimension (the smaller of dimensions as common) and below EXACT when scaled."""
    v = F.col("v")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < EXACT)) & (F.size(v) > 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(v.isNotNull()).where(F.coalesce(good, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else -1)).select("id", integers(v).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _summed(rows: DataFrame, shape: tuple[int, ...], kind: type, part, spread: int) -> np.ndarray:
    """The sum over all tasks of part(batches), arrays of `shape`: tasks add up their rows, a few more tasks those sums, the driver the rest."""

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    def first(batches):
        total = np.zeros(shape, kind)
        for b in batches:
            total += part(b)
        yield packed(total)

    def second(batches):
        total, some = np.zeros(shape, kind), False
        for b in batches:
            for raw in b.column("sum").to_pylist():
                total, some = total + np.frombuffer(raw, kind).reshape(shape), True
        if some:
            yield packed(total)

    sums = rows.mapInArrow(first, "sum binary").repartition(spread).mapInArrow(second, "sum binary")
    return sum((np.frombuffer(r["sum"], kind).reshape(shape) for r in sums.collect()), np.zeros(shape, kind))


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """Rows minus the mean: its whole part comes off exactly, only the rest is rounded."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(np.float64) - np.array([s % n / n for s in sums])


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Sum over dimensions of (n x - sum) ** 2, exact; null where it takes more than 64 bits."""
    off = x - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    if len(sums) * (n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 < 1 << 63:
        return np.square(n * off - np.array(rest, np.int64)).sum(axis=1).tolist()
    exact = (sum((n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in off.tolist())
    return [d if d < 1 << 63 else None for d in exact]


@dataclass
class Components:
    """vectors: unit eigenvectors as columns; values: their eigenvalues, falling; residuals of both, of the largest eigenvalue.

    trace of the covariance; sums of each dimension over n rows; identity_error: what the whitened rows' covariance is off
    the identity at most; passes over the rows.
    """

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    sums: list[int]
    n: int
    identity_error: float
    passes: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.sums, self.n) @ (self.vectors / np.sqrt(self.values))


def _ritz(q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz vectors, values (falling) and residuals of a block and its image."""
    small = q.T @ z
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return vectors, values, np.linalg.norm(z @ turn - vectors * values, axis=0)


def _passes_left(values: np.ndarray, residual: float, k: int) -> float:
    """How many passes bring the residual of component k down to the tolerance: each takes it by the last value over that of k."""
    ratio = min(max(values[-1], 0.0) / values[k - 1], 1 - 1e-9) if values[k - 1] > 0 else 0.0
    return 1.0 if ratio <= 1e-12 else math.log(max(1.0, residual / (TOLERANCE * values[0]))) / -math.log(ratio)


def fit(rows: DataFrame, dim: int, k: int = COMPONENTS) -> Components:
    """The k leading components of the rows' covariance (divisor: how many rows), or all whose eigenvalue is not zero, if fewer.

    rows: one column, arrays of `dim` integers; at least one row. They are read once a pass.
    """
    spread = max(1, math.isqrt(partitions(rows.sparkSession)))

    def counted(b):  # in two halves of 32 bits, which no number of rows overflows
        x = _matrix(b.column(0), dim)
        return np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), [b.num_rows]])

    count = _summed(rows, (2 * dim + 1,), np.int64, counted, spread).tolist()
    sums, n = [(a << 32) + b for a, b in zip(count[:dim], count[dim:-1], strict=True)], count[-1]

    def image(q: np.ndarray) -> tuple[np.ndarray, float]:
        def part(b):
            y = centred(_matrix(b.column(0), dim), sums, n)
            return np.vstack([y.T @ (y @ q), np.full((1, q.shape[1]), np.square(y).sum())])

        total = _summed(rows, (dim + 1, q.shape[1]), np.float64, part, spread) / n
        return total[:-1], float(total[-1, 0])

    k, rng = min(k, dim), np.random.default_rng(12)
    width, passes, tried = min(dim, k + SPARE), 0, 0
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    while True:
        z, trace = image(q)
        vectors, values, residuals = _ritz(q, z)
        passes, tried = passes + 1, tried + 1
        worst, top = residuals[:k].max(), max(values[0], 0.0)
        if worst <= TOLERANCE * top or width == dim:  # a block of all dimensions is exact
            break
        if tried >= PATIENCE or tried + _passes_left(values, worst, k) > PATIENCE:
            z, width, tried = np.hstack([vectors, rng.standard_normal((dim, min(dim, 2 * width) - width))]), min(dim, 2 * width), 0
        q = np.linalg.qr(z)[0]
    kept = int((values[:k] > TOLERANCE * top).sum()) if top > 0 else 0
    vectors, values = vectors[:, :kept], values[:kept]
    if not kept:
        return Components(vectors, values, np.zeros(0), trace, sums, n, 0.0, passes)
    z, _ = image(vectors)  # the certificate: what the components do to the rows themselves
    off = vectors.T @ z / np.sqrt(np.outer(values, values)) - np.eye(kept)
    return Components(vectors, values, np.linalg.norm(z - vectors * values, axis=0) / top, trace, sums, n, float(np.abs(off).max()), passes + 1)


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, residuals, identity_error) of each usable row: arrays by component.

    The covariance is that of the distinct rows, n of them. deviation is the sum over dimensions of (n x - sums) ** 2 (null
    beyond 64 bits). whitened: the centred row on each component, over the root of its eigenvalue; explained: the
    eigenvalue's share of the trace; residuals: of each component, as a share of the largest eigenvalue. Components are
    fewer than k where fewer dimensions vary, and none where all rows are alike. Rows whose vector is null, empty, of
    another than the commonest dimension, or holds null, non-finite or larger than exact components take no part; null and
    repeated ids pass. An empty table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    out = f"id {kind}, deviation long, whitened array<double>"
    distinct = cut(rows.select("x").distinct())
    first = distinct.first()
    if first is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, residuals array<double>, identity_error double")
    dim = len(first["x"])
    found = fit(distinct, dim, k)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), dim)
            white = found.whitened(x)
            offsets = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviations(x, found.sums, found.n), pa.int64()), listed], names=["id", "deviation", "whitened"])

    array = lambda x: F.lit([float(v) for v in x]).cast("array<double>") if len(x) else F.array().cast("array<double>")
    whole = rows.mapInArrow(run, out)
    return whole.select(F.col("id").alias(id_col), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", array(found.values / found.trace if found.trace else []).alias("explained"), array(found.residuals).alias("residuals"), F.lit(found.identity_error).alias("identity_error"))


def op12_whitening(embeddings: DataFrame) -> DataFrame:
    """The columns of the query: a row for each vector and component."""
    rows = whiten(embeddings)
    by = lambda c: F.get(F.col(c), F.col("pos"))
    long = rows.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("pos", "whitened"), "explained", "identity_error", "residuals")
    return long.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "whitened", by("explained").alias("explained"), "identity_error", by("residuals").alias("residual"))
