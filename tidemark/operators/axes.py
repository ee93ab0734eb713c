"""Local principal axes in overlapping depth blocks, turned to agree with the global ones and blended row by row.

Neighbouring blocks' axes differ by sign, order and rotation, so their scores can't be mixed as they are. Each block's axes are turned by the
orthogonal matrix that brings them nearest the global axes (Procrustes), which makes the result independent of how a block's own
axes came out. A row's scores are the mean over the blocks it lies in, weighted by a triangle around each block's centre. Blocks with few
rows use the global axes and mean. All blocks' sums come from one job (count, sum and outer products, combined in tasks); the axes are a
small model, and scoring is one narrow stage: rows are never copied for the blocks that they lie in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.learning import leading


@dataclass(frozen=True)
class Blocks:
    """Block b covers |y - (lo + b * step)| < half, 0 <= b < count."""

    lo: float
    step: float = 100.0
    half: float = 100.0
    count: int = 1

    @property
    def centres(self) -> np.ndarray:
        return self.lo + self.step * np.arange(self.count)

    def weights(self, y: np.ndarray) -> np.ndarray:
        """(rows, blocks): max(0, 1 - |y - centre| / half) + 1e-3 inside a block, 0 outside."""
        off = np.abs(y[:, None] - self.centres[None])
        return np.where(off < self.half, 1 - off / self.half + 1e-3, 0.0)


def _unit(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def sums(rows: DataFrame, y: str, vector: str, blocks: Blocks, dim: int) -> np.ndarray:
    """(1 + blocks, 1 + dim + dim * dim): count, sum and outer products of unit vectors, of all rows and of each block's."""
    width = 1 + dim + dim * dim

    def run(batches):
        total = np.zeros((1 + blocks.count, width))
        for batch in batches:
            v = _unit(batch.column(1))
            inside = np.concatenate([np.ones((len(v), 1)), blocks.weights(batch.column(0).to_numpy(zero_copy_only=False)) > 0], 1)
            outer = (v[:, :, None] * v[:, None]).reshape(len(v), -1)
            total += inside.T @ np.concatenate([np.ones((len(v), 1)), v, outer], 1)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    out = np.zeros((1 + blocks.count) * width)
    usable = rows.where(F.col(y).isNotNull() & F.col(vector).isNotNull()).select(F.col(y).cast("double"), vector)
    for r in usable.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(1 + blocks.count, width)


def aligned(axes: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The orthogonal turn of axes (k, dim) that comes nearest the target axes."""
    u, _, v = np.linalg.svd(axes @ target.T)
    return (u @ v).T @ axes


def local_axes(total: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """means (blocks, dim), axes (blocks, k, dim) and spreads (blocks, k) of the blocks' sums, aligned to the global axes."""
    dim = int((np.sqrt(4 * total.shape[1] - 3) - 1) / 2)

    def moments(s):
        mean = s[1 : 1 + dim] / max(s[0], 1)
        return mean, s[1 + dim :].reshape(dim, dim) / max(s[0], 1) - np.outer(mean, mean)

    mean, cov = moments(total[0])
    target = leading(cov, k)
    means, axes, spread = [], [], []
    for s in total[1:]:
        m, c = moments(s) if s[0] >= least else (mean, cov)
        turned = aligned(leading(c, k), target)
        means.append(m)
        axes.append(turned)
        spread.append(np.sqrt(np.maximum(np.einsum("kd,de,ke->k", turned, c, turned), 1e-24)))
    return np.array(means), np.array(axes), np.array(spread)


def blended(rows: DataFrame, ident: str, y: str, vector: str, blocks: Blocks, dim: int, k: int = 3, least: int = 1500) -> DataFrame:
    """ident, blocks (that the row lies in), s0..: scores over their block's spread, blended. Rows with a null depth or vector, or in no
    block, are left out."""
    kind = rows.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, blocks int, " + ", ".join(f"s{i} double" for i in range(k))
    means, axes, spread = local_axes(sums(rows, y, vector, blocks, dim), k, least)

    def run(batches):
        for batch in batches:
            v, w = _unit(batch.column(2)), blocks.weights(batch.column(1).to_numpy(zero_copy_only=False))
            some = np.flatnonzero(w.sum(1) > 0)
            v, w = v[some], w[some]
            score = (np.einsum("nd,bkd->nbk", v, axes) - np.einsum("bd,bkd->bk", means, axes)) / spread
            s = np.einsum("nb,nbk->nk", w, score) / w.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array((w > 0).sum(1).astype(np.int32)), *(pa.array(c) for c in s.T)], [ident, "blocks", *[f"s{i}" for i in range(k)]])

    return rows.where(F.col(y).isNotNull() & F.col(vector).isNotNull()).select(ident, F.col(y).cast("double"), vector).mapInArrow(run, schema)
