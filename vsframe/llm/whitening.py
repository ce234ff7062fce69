"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers (``floor(1024 * c) + 100000``), so that sums and
the centred scatter are exact and do not depend on the order in which tasks
add. Tasks centre their rows by the rounded mean, multiply, and combine; a
rank-one term for the mean's fraction, exact too, completes the centring. The
covariance, d x d, is decomposed on the driver: Cholesky with diagonal
pivoting gives a triangular factor, and Jacobi rotations of its columns make them
orthogonal. Then squared column norms are eigenvalues and normalised columns the
components. No eigenvalue routine is called.

Passes over the table: lengths, sums, scatter, the whitened covariance, output.
Only d sums, d * (d + 1) / 2 scatter entries and k * k check values reach the
driver, whatever the number of rows; d is the width of a vector.

Nulls: a vector that is null or holds a null or non-finite entry is left out, as
is one of another length than most have (ties: the longest; empty ones always).
Null ids stay. Repeated rows count and return each time. Equal eigenvalues keep
the order of their pivots. A direction without variance gives no component, so
one vector, equal vectors, or an empty table give no rows. An entry beyond
2**52 raises ValueError, as its number does not fit a long. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 1024.0, 100_000
#: Largest absolute entry; its number and sums of two fit 64 bits.
MAX_ENTRY = float(1 << 52)
_WHOLE = pa.decimal128(38, 0)


class Whitening(NamedTuple):
    """What one fit gives. ``centre`` is the rounded mean of the numbers, ``rest``
    the sums of their distances from it, ``sums`` their plain sums; rows of
    ``components`` are unit eigenvectors by falling ``eigenvalues``."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Centred projections of numbers (rows of x), each over its deviation."""
        centred = (x - self.centre) - self.rest.astype(np.float64) / self.n
        return centred @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S)^2, exact; null beyond a long."""
        y = x - self.centre
        most = self.n * int(np.abs(y).max(initial=0)) + int(np.abs(self.rest).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            far = self.n * y - self.rest.astype(np.int64)
            return pa.array(np.einsum("ij,ij->i", far, far))
        far = self.n * y.astype(object) - self.rest
        return pa.array([v if (v := int((row * row).sum())) < 1 << 63 else None for row in far], pa.int64())


def _good(vector: Column) -> Column:
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, finite), F.lit(False))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0) >= MAX_ENTRY:
        raise ValueError(f"an entry of a vector is beyond {MAX_ENTRY:.0f}")
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, width)


def _exact(rows: np.ndarray, most: int) -> np.ndarray:
    """Rows' sum as Python integers; ``most`` bounds an absolute entry."""
    fits = most * max(1, len(rows)) < 1 << 63
    return rows.sum(0).astype(object) if fits else rows.astype(object).sum(0)


def _gram(y: np.ndarray) -> np.ndarray:
    """y^T y in Python integers: float products of so few rows that no sum
    passes 2^53, where doubles still hold every whole number."""
    most = max(1, int(np.abs(y).max(initial=0)))
    step = (1 << 53) // (most * most)
    if not step:
        wide = y.astype(object)
        return wide.T @ wide
    out = np.zeros((y.shape[1],) * 2, object)
    for lo in range(0, len(y), step):
        part = y[lo : lo + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _sums(kept: DataFrame, width: int) -> list[int]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            x = _numbers(batch.column(0), width)
            total += _exact(x, int(np.abs(x).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(Decimal, total), _WHOLE)], ["i", "v"])

    rows = kept.mapInArrow(work, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = [0] * width
    for r in rows:
        out[r.i] = int(r.v)
    return out


def _scatter(kept: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sum of outer products of x - centre, in Python integers."""
    width = len(centre)
    low = np.tril_indices(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            total += _gram(_numbers(batch.column(0), width) - centre)
        columns = [pa.array(i, pa.int32()) for i in low] + [pa.array(map(Decimal, total[low]), _WHOLE)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    found = kept.mapInArrow(work, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width), object)
    i, j = (found.column(c).to_numpy() for c in ("i", "j"))
    out[i, j] = out[j, i] = [int(v) for v in found.column("v").to_pylist()]
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): v[order][:, order] = L L^T, L lower trapezoidal with as many
    columns as v has rank. The largest remaining diagonal entry comes next."""
    d = len(v)
    a, order = v.copy(), np.arange(d)
    factor = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(0.0, a.diagonal().max(initial=0))
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for x in (a, factor):
            x[[k, p]] = x[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal.

    Each sweep meets all pairs of columns in rounds of disjoint pairs (one
    column fixed, the others turning), which rotate at once.
    """
    g = factor.T.copy()  # rows are the columns that rotate
    r = len(g)
    if r < 2:
        return g.T
    ring = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            a, b, c = (np.einsum("ij,ij->i", x, y) for x, y in ((g[p], g[p]), (g[q], g[q]), (g[p], g[q])))
            on = np.abs(c) > 4 * np.finfo(float).eps * np.sqrt(a * b)
            if on.any():
                turned = True
                p, q, a, b, c = p[on], q[on], a[on], b[on], c[on]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                g[p], g[q] = cos[:, None] * g[p] - sin[:, None] * g[q], sin[:, None] * g[p] + cos[:, None] * g[q]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            return g.T
    raise ArithmeticError(f"columns are not orthogonal after {sweeps} sweeps")


def decompose(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of a covariance, as many
    as its rank. The largest entry of a vector is positive."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(by), len(v)))
    vectors[:, order] = (turned[:, by] / norms[by]).T
    top = np.abs(vectors).argmax(1)[:, None]
    return norms[by] ** 2, vectors * np.sign(np.take_along_axis(vectors, top, 1))


def fit_whitening(kept: DataFrame, width: int, n: int, most: int) -> Whitening:
    """Fit on all rows of ``kept``, whose one column holds good vectors."""
    sums = _sums(kept, width)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, centre)], object)
    centre = np.array(centre, np.int64)
    scatter = n * _scatter(kept, centre) - np.outer(rest, rest)  # n^2 times the covariance, exact
    covariance = (scatter / (n * n)).astype(np.float64)
    values, vectors = decompose(covariance)
    trace = int(scatter.trace()) / (n * n)
    return Whitening(n, sums, centre, rest, vectors[:most], values[:most], values[:most] / trace if trace else values[:most])


def _identity_error(kept: DataFrame, width: int, fit: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the
    identity. Rows are centred when whitened; the mean that rounding leaves is
    taken off too."""
    k = len(fit.eigenvalues)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = fit.whiten(_numbers(batch.column(0), width))
            total += np.vstack([w.T @ w, w.sum(0)])
        i, j = np.indices(total.shape)
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in kept.mapInArrow(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[k] / fit.n
    return float(np.abs(total[:k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten_embeddings(
    embeddings: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector and component up to ``most``: the id, component, n,
    deviation, whitened, explained, identity_error (see the module)."""
    fields = [T.StructField(n, t) for n, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()))]
    fields += [T.StructField(n, T.DoubleType()) for n in ("whitened", "explained", "identity_error")]
    schema = T.StructType([embeddings.schema[id_col], *fields])
    good = embeddings.select(F.col(id_col), F.col(vector_col).alias("v")).where(_good(F.col("v")))
    common = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    width, n = common.d, common.n
    kept = good.where(F.size("v") == width)
    fit = fit_whitening(kept.select("v"), width, n, most)
    k = len(fit.eigenvalues)
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = _identity_error(kept.select("v"), width, fit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch.column(1), width)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n, np.int64)),
                fit.deviations(x).take(each),
                pa.array(fit.whiten(x).ravel()),
                pa.array(np.tile(fit.explained, len(x))),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(work, schema)
