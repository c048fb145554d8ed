"""Whitening of vectors by spectral divide and conquer.

The covariance of all distinct vectors is summed by Spark and is as large as the square of the dimension, whatever the number of rows.
Its components are found by splitting: the polar factor of the covariance less a shift is a matrix sign, (I + U) / 2 projects
on the components with eigenvalues above the shift, and the covariance restricted to either invariant subspace is split
again, until a subspace is a line. The polar factor comes from QDWH, the dynamically weighted Halley iteration on QR factors. The projection is broadcast
and whitens all rows where they lie.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, with_arrays

_EPS = np.finfo(np.float64).eps


def polar_factor(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QDWH in its QR form (no matrix is inverted).

    Weights follow a lower bound on the smallest singular value, here always eps, so that six or seven rounds do for any matrix that is regular
    in double precision. A singular one has no unique factor; what comes out then is no sign and callers test for that.
    """
    size = len(a)
    bound = np.linalg.norm(a)
    if bound == 0:
        return np.eye(size)
    x = a / bound
    low = _EPS
    for _ in range(rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square ** 2)
        first = np.sqrt(1 + d)
        wa = first + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * first))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:size] @ q[size:].T
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < np.cbrt(_EPS) * 0.1 and abs(low - 1) < 1e-8:
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of a symmetric matrix above and below a shift, or None if it is a multiple of I.

    The shift is the median of the diagonal, which tends to halve the spectrum; where that splits nothing off, or lies on an
    eigenvalue, values around the mean are tried: the mean lies strictly inside any spectrum that isn't a single value.
    """
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= size * _EPS * np.linalg.norm(a):
        return None
    best = None
    for shift in (np.median(np.diag(a)), mean, mean + spread / size / 7, mean - spread / size / 7, mean + spread / size / 3, mean - spread / size / 3):
        sign = polar_factor(a - shift * np.eye(size))
        upper = (np.eye(size) + (sign + sign.T) / 2) / 2
        rank = int(np.rint(np.trace(upper)))
        if not 0 < rank < size:
            continue
        # the columns of the projector span its range: a basis of the largest, made exact by projecting it again
        start = np.argsort(-np.linalg.norm(upper, axis=0), kind="stable")[:rank]
        basis = np.linalg.qr(upper @ np.linalg.qr(upper[:, start] + upper @ _mixing(size, rank))[0], mode="complete")[0]
        high, rest = basis[:, :rank], basis[:, rank:]
        left = np.linalg.norm(rest.T @ a @ high)
        if best is None or left < best[0]:
            best = left, high, rest
        if left <= 10 * size * _EPS * np.linalg.norm(a):
            break
    return None if best is None else best[1:]


def _mixing(rows: int, columns: int) -> np.ndarray:
    """A fixed full matrix with small entries, so that dependent columns of a projector don't end up in one basis."""
    return np.cos(np.outer(np.arange(1, rows + 1) ** 0.5, np.arange(1, columns + 1) * 2.399963)) / rows ** 0.5


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    done: list[tuple[float, np.ndarray]] = []
    todo = [np.eye(len(a))]
    while todo:
        basis = todo.pop()
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        parts = _halves(inner) if len(inner) > 1 else None
        if parts is None:  # a line, or a subspace all of whose directions are alike
            done += [(float(inner[k, k]), basis[:, k]) for k in range(len(inner))]
        else:
            todo += [basis @ part for part in parts]
    done.sort(key=lambda pair: -pair[0])
    vectors = np.stack([v for _, v in done], axis=1)
    values = np.einsum("ik,ij,jk->k", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def grid_vectors(vectors: DataFrame, vector_col: str, x_col: str, scale: int, offset: int) -> DataFrame:
    """Rows of ``vectors`` whose vector holds no null and no non-finite entry, with ``x_col`` (array of long): floor(scale * c) + offset of every
    entry c, taken as double."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = vectors.filter(F.col(vector_col).isNotNull() & ~F.exists(vector_col, entry))
    return kept.withColumn(x_col, F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint") + F.lit(offset)))


def _matrix(batch: pa.RecordBatch, column: str, size: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _added(rows: DataFrame, part, kind: str) -> np.ndarray:
    """Sum over all batches of ``rows`` of the array that ``part`` makes of one; every task adds up its own, Spark adds up the tasks. Its size
    doesn't depend on the rows."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(batch)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": np.arange(total.size), "value": total.ravel()})

    found = rows.mapInArrow(run, f"place bigint, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    return found.sort_values("place")["value"].to_numpy()


def covariance(rows: DataFrame, column: str, size: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance, divisor ``n``, of integer vectors with the given sums. Entries are centred exactly, as n*x-S, before they are multiplied."""
    origin = np.array(sums, dtype=np.int64)

    def part(batch):
        centred = (_matrix(batch, column, size) * n - origin) / n
        return centred.T @ centred

    found = _added(rows.select(column), part, "double")
    return found.reshape(size, size) / n if len(found) else np.zeros((size, size))


class Whitening:
    """What is broadcast: n, sums, the projection over the root of the eigenvalues, shares of variance."""

    def __init__(self, n: int, sums: list[int], cov: np.ndarray, components: int):
        values, vectors = eigen(cov)
        trace = float(np.trace(cov))
        values, vectors = values[:components], vectors[:, :components]
        #: components without variance have no whitened value
        self.live = values > len(cov) * _EPS * max(trace, 0.0)
        self.n, self.sums = n, np.array(sums, dtype=np.int64)
        self.projection = vectors / np.sqrt(np.where(self.live, values, 1.0))
        self.explained = [float(v) / trace if trace > 0 else None for v in np.maximum(values, 0.0)]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x * self.n - self.sums) / self.n) @ self.projection


def fit(points: DataFrame, x_col: str, components: int) -> tuple[Whitening | None, float | None]:
    """The whitening of the distinct vectors ``points`` (a written table), and the largest absolute entry of the whitened vectors' covariance
    less I (over the components with variance; None without any). None for an empty table."""
    sizes = points.select(F.size(x_col).alias("size")).distinct().limit(2).collect()
    if not sizes:
        return None, None
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    size = sizes[0]["size"]
    if size == 0:
        return None, None
    n = points.count()
    sums = [int(v) for v in _added(points.select(x_col), lambda b: _matrix(b, x_col, size).sum(axis=0), "bigint")]
    found = Whitening(n, sums, covariance(points, x_col, size, n, sums), components)
    live = np.flatnonzero(found.live)
    if not len(live):
        return found, None

    def part(batch):
        w = found.apply(_matrix(batch, x_col, size))[:, live]
        return w.T @ w  # their mean is zero: x was centred

    inner = _added(points.select(x_col), part, "double").reshape(len(live), len(live)) / n
    return found, float(np.abs(inner - np.eye(len(live))).max())


def whiten(rows: DataFrame, whitening: Whitening | None, x_col: str) -> DataFrame:
    """``rows`` with ``whitened`` (array of double, one per component, null for a component without variance) and ``deviation`` (long: the exact
    sum over dimensions of (n*x-S)^2; an error if it exceeds a long). Existing columns of these names are replaced, others pass."""
    fields = extended(rows, ("whitened", "array<double>"), ("deviation", "bigint"))
    if whitening is None:
        return rows.sparkSession.createDataFrame([], fields)
    shared = rows.sparkSession.sparkContext.broadcast(whitening)

    def run(batches):
        w = shared.value
        size, count = w.projection.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, x_col, size)
            centred = x * w.n - w.sums
            if (np.square(centred / 1.0).sum(axis=1) > 9.2e18).any():
                raise OverflowError("a deviation exceeds 64 bits")
            out = w.apply(x)
            dead = np.broadcast_to(~w.live, out.shape)
            values = pa.array(out.ravel(), mask=dead.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, count, dtype=np.int32)), values)
            yield with_arrays(batch, {"whitened": lists, "deviation": pa.array(np.square(centred).sum(axis=1))})

    return rows.mapInArrow(run, fields)
