"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Components c become floor(scale * c) as whole numbers. The fit list holds each distinct vector once (aggregated before the shuffle, so
a vector that a third of the rows share is one row a task). Three passes over it return sums: n and S, exact; the scatter of x - S/n,
centred before multiplying, summed row by row of the matrix; and the covariance of the whitened vectors, for the identity error. Only
sums of the dimension's size squared reach the driver. There the scatter C = L L' is factored with diagonal pivoting, and rotations of L's columns make
them orthogonal: their norms squared are C's eigenvalues, the normalised columns its eigenvectors. C is never squared or diagonalised.

Rows with a null vector or a null or non-finite entry are left out, and so are those of another length than most distinct vectors have
(of equally common lengths the longer). Every other row gives one row for each component, repeated ids and null ids too. Components
with an eigenvalue of 0 (to rounding) can't be whitened and have no rows: a fit list of one vector, or an empty table, gives none.
A deviation beyond 64 bits is null. Components have their largest entry positive (the first of equal ones).
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, tune, written
from tidemark.llm.vectors import entries, quantised, unpack

SCALE, COMPONENTS = 256.0, 4


@dataclass
class Model:
    n: int
    sums: list[int]
    values: np.ndarray  # falling eigenvalues of V, as many as its rank
    axes: np.ndarray  # rows: unit eigenvectors
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def pivoted_cholesky(c: np.ndarray) -> np.ndarray:
    """L (d, rank) with L L' = c; each step takes the largest diagonal entry left, and ends where that is rounding."""
    d = len(c)
    rest, left = np.diag(c).astype(np.float64).copy(), []
    least = rest.max(initial=0.0) * d * np.finfo(np.float64).eps
    out = np.zeros((d, d))
    for k in range(d):
        p = int(rest.argmax())
        if rest[p] <= least:
            return out[:, :k]
        column = (c[:, p] - out[:, :k] @ out[p, :k]) / np.sqrt(rest[p])
        column[left] = 0.0
        out[:, k] = column
        rest = rest - column * column
        left.append(p)
        rest[left] = -np.inf
    return out


def jacobi(factor: np.ndarray, sweeps: int = 40, tol: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns), norms falling, of the factor after rotations that make its columns orthogonal.

    A sweep meets all pairs of columns in rounds of disjoint pairs, so a round is one vector operation.
    """
    a = factor.copy()
    d, r = a.shape
    m = r + r % 2
    ring = np.arange(m)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(m - 1):
            i, j = ring[: m // 2], ring[m // 2 :][::-1]
            ok = (i < r) & (j < r)
            i, j = i[ok], j[ok]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.abs(xy) > tol * size
            worst = max(worst, float((np.abs(xy) / np.where(size > 0, size, 1)).max(initial=0.0)))
            zeta = (yy - xx) / np.where(off, 2 * xy, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(off, t, 0.0)
            cos = 1 / np.hypot(1.0, t)
            a[:, i], a[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
            ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])
        if worst <= 1e-14:
            break
    norm = np.sqrt((a * a).sum(0))
    order = np.argsort(-norm, kind="stable")
    return norm[order] ** 2, (a / np.where(norm > 0, norm, 1))[:, order]


def _moments(batches):
    """dim, i, n, s: of each task's distinct vectors, by length: exact sums of entry i."""
    total: dict[int, list] = {}
    for batch in batches:
        for rows, x in unpack(batch.column(0).to_pylist()):
            # a batch of int64 can pass 64 bits in a sum only if its entries come near that
            s = x.sum(0) if np.abs(x).max() < 1 << 40 else x.astype(object).sum(0)
            n, old = total.get(x.shape[1], (0, [0] * x.shape[1]))
            total[x.shape[1]] = [n + len(rows), [int(a) + int(b) for a, b in zip(old, s, strict=True)]]
    for dim, (n, s) in total.items():
        cols = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(v) for v in s])]
        yield pa.RecordBatch.from_arrays(cols, ["dim", "i", "n", "s"])


def centred(x: np.ndarray, model_n: int, sums: list[int], mean: np.ndarray) -> np.ndarray:
    """x - S / n, from n * x - S where that is exact."""
    most = model_n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    return (model_n * x - np.array(sums, np.int64)) / model_n if most < 1 << 53 else x - mean


def _scatter(dim: int, n: int, sums: list[int], mean: np.ndarray):
    def run(batches):
        total, some = np.zeros((dim, dim)), False
        for batch in batches:
            for _, x in unpack(batch.column(0).to_pylist()):
                if x.shape[1] == dim:
                    c = centred(x, n, sums, mean)
                    total += c.T @ c
                    some = True
        if some:
            rows = pa.ListArray.from_arrays(pa.array(np.arange(dim + 1) * dim, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), rows], ["i", "row"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """One row of a matrix from all tasks' parts of it."""
    column = table["row"].combine_chunks()
    parts = column.flatten().to_numpy().reshape(len(column), -1)
    return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([parts.sum(0)], pa.list_(pa.float64()))})


def gathered(parts: DataFrame) -> np.ndarray:
    """The sum over tasks of a matrix that came in rows (i, row): rows are summed in the cluster, the matrix is collected."""
    rows = sorted(parts.groupBy("i").applyInArrow(_summed, "i int, row array<double>").collect(), key=lambda r: r["i"])
    return np.array([r["row"] for r in rows])


def fit(df: DataFrame, vector: str = "embedding", scale: float = SCALE) -> tuple[Model | None, DataFrame]:
    """The model of the distinct vectors of df, and their table (x, packed) in the shared folder. No usable vector: None."""
    tune(df.sparkSession)
    listed = written(quantised(df, {}, vector, scale).distinct(), "fit-list")
    sums = listed.mapInArrow(_moments, "dim int, i int, n long, s string").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not sums:
        return None, listed
    n, dim = max((r["n"], r["dim"]) for r in sums)
    s = [int(r["s"]) for r in sorted((r for r in sums if r["dim"] == dim), key=lambda r: r["i"])]
    mean = np.array([float(Fraction(v, n)) for v in s])
    c = gathered(listed.mapInArrow(_scatter(dim, n, s, mean), "i int, row array<double>"))
    c = (c + c.T) / 2
    values, axes = jacobi(pivoted_cholesky(c))
    axes = axes.T
    if len(axes):
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Model(n, s, values / n, axes, float(np.trace(c)) / n), listed


def identity_error(listed: DataFrame, model: Model, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance over the fit list, less the identity."""
    turn, n, sums, mean, dim = (model.axes[:k] / np.sqrt(model.values[:k])[:, None]).T, model.n, model.sums, model.mean, len(model.sums)

    def run(batches):
        total, some = np.zeros((k + 1, k)), False
        for batch in batches:
            for _, x in unpack(batch.column(0).to_pylist()):
                if x.shape[1] == dim:
                    y = centred(x, n, sums, mean) @ turn
                    total += np.concatenate([y.T @ y, y.sum(0)[None]])
                    some = True
        if some:
            rows = pa.ListArray.from_arrays(pa.array(np.arange(k + 2) * k, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1), pa.int32()), rows], ["i", "row"])

    total = gathered(listed.mapInArrow(run, "i int, row array<double>"))
    middle = total[k] / n
    return float(np.abs(total[:k] / n - np.outer(middle, middle) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; None beyond 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
    if most * most * len(sums) < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in map(int, (d * d).sum(1))]


def whitened(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """ident, component (from 1), n, deviation, whitened, explained, identity_error for each usable row and component."""
    kind = df.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, listed = fit(df, vector, scale)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    k = min(components, len(model.values))
    error, n, sums, mean, dim = identity_error(listed, model, k), model.n, model.sums, model.mean, len(model.sums)
    dropped(listed)
    turn, share = (model.axes[:k] / np.sqrt(model.values[:k])[:, None]).T, model.values[:k] / model.trace

    def run(batches):
        for batch in batches:
            rows, at, flat = entries(batch.column(1), scale)
            own = np.flatnonzero(np.diff(at) == dim)
            x = flat[(at[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim)
            y = centred(x, n, sums, mean) @ turn
            m = len(own)
            cols = [
                batch.column(0).take(pa.array(np.repeat(rows[own], k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()),
                pa.array([v for v in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                pa.array(y.ravel()),
                pa.array(np.tile(share, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, [ident, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(ident, vector).mapInArrow(run, schema)
