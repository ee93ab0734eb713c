"""Volumes of activity by time bin, smoothed and registered in pairs by correlation in the frequency domain.

Events are counted into voxels (one aggregation); a time bin's volume is the row of its non-empty voxels, so the table follows the events.
Blocks of bins meet in pairs: a group holds at most 2 * block volumes, builds them densely, smooths them along each axis, subtracts
their means, and correlates all pairs at once: one transform a volume, one product a frequency, one inverse transform a pair, from which the lags are
cut. Padding to the volume plus the largest lag keeps the ends from meeting. The best and the soft displacement are taken in the group;
lags are never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Grid:
    """Low edges, voxel sizes (um) and numbers of voxels by axis."""

    lo: tuple[float, float, float]
    size: tuple[float, float, float]
    shape: tuple[int, int, int]

    def index(self, axis: int, value: Column) -> Column:
        return F.floor((value - self.lo[axis]) / self.size[axis])

    def inside(self, x: Column, y: Column, z: Column) -> Column:
        ok = F.lit(True)
        for i, v in enumerate((x, y, z)):
            ok = ok & (self.index(i, v) >= 0) & (self.index(i, v) < self.shape[i])
        return ok


def grid_for_probe(spark: SparkSession, voxel=(10.0, 10.0, 20.0), pad=(20.0, 20.0), depth: float = 80.0) -> Grid:
    """The grid around all contacts, padded sideways and along the probe; from their extremes."""
    from tidemark.sources.recording import channels

    r = channels(spark).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    span = (r["b"] - r["a"] + 2 * pad[0], r["d"] - r["c"] + 2 * pad[1], depth)
    return Grid((r["a"] - pad[0], r["c"] - pad[1], 0.0), tuple(voxel), tuple(int(np.ceil(s / v)) for s, v in zip(span, voxel)))


def volumes(events: DataFrame, grid: Grid, time_bin: float, every: int = 1, x: str = "x", y: str = "y", z: str = "z", weight: str | None = None) -> DataFrame:
    """bin, voxels (array of struct<v, w>, v = (ix * ny + iy) * nz + iz) of every `every`-th time bin; events outside the grid are left out."""
    cols = [F.col(c) for c in (x, y, z)]
    i = [grid.index(k, c) for k, c in enumerate(cols)]
    v = (i[0] * grid.shape[1] + i[1]) * grid.shape[2] + i[2]
    d = events.where(grid.inside(*cols)).select(F.floor(F.col("t") / time_bin).alias("bin"), v.alias("v"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    d = d.where(F.col("bin") % every == 0).groupBy("bin", "v").agg(F.sum("w").alias("w"))
    return d.groupBy("bin").agg(F.collect_list(F.struct("v", "w")).alias("voxels"))


def smoother(n: int, sigma: float) -> np.ndarray:
    """(n, n) Gaussian smoothing along an axis, taps to 3 sigma of sum 1, zeros beyond the ends."""
    if sigma <= 0:
        return np.eye(n)
    reach = max(1, int(3 * sigma + 0.5))
    k = np.arange(n)[:, None] - np.arange(n)[None]
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.where(np.abs(k) <= reach, np.exp(-0.5 * (k / sigma) ** 2), 0.0) / taps.sum()


def dense(rows: list, shape: tuple[int, int, int], sigma=(0.0, 0.0, 0.0)) -> np.ndarray:
    """(bins, x, y, z) from lists of voxels, smoothed along each axis."""
    v = np.zeros((len(rows), int(np.prod(shape))))
    for i, cells in enumerate(rows):
        for c in cells:
            v[i, c["v"]] += c["w"]
    v = v.reshape(-1, *shape)
    for axis, s in enumerate(sigma):
        if s > 0:
            v = np.moveaxis(np.tensordot(smoother(shape[axis], s), v, (1, axis + 1)), 0, axis + 1)
    return v


def normalised(v: np.ndarray) -> np.ndarray:
    """Each volume less its mean, of unit length; a flat one is zero."""
    v = v - v.mean((1, 2, 3), keepdims=True)
    size = np.sqrt((v * v).sum((1, 2, 3), keepdims=True))
    return v / np.where(size > 1e-12, size, np.inf)


def correlations(a: np.ndarray, b: np.ndarray, most: tuple[int, int, int]) -> np.ndarray:
    """(A, B, lags x, y, z): sum over voxels of a(v + lag) b(v) for |lag| <= most, nothing beyond the volume.

    Axes without lags are summed by one matrix product a frequency; the others are transformed at their length plus the largest lag.
    """
    moving = [i for i in range(3) if most[i] > 0]
    axes = tuple(i + 1 for i in moving)
    if not moving:
        return np.einsum("axyz,bxyz->ab", a, b)[..., None, None, None]
    length = [a.shape[i] + most[i - 1] for i in axes]
    fa, fb = np.fft.rfftn(a, length, axes), np.fft.rfftn(b, length, axes)
    still = [i + 1 for i in range(3) if i not in moving]
    order = [*axes, 0, *still]
    kept = [fa.shape[i] for i in axes]
    n_still = int(np.prod([fa.shape[i] for i in still])) if still else 1
    pa_, pb = (f.transpose(order).reshape(*kept, f.shape[0], n_still) for f in (fa, fb))
    power = np.matmul(pa_, np.conj(np.swapaxes(pb, -1, -2)))
    power = np.moveaxis(power, (-2, -1), (0, 1))
    full = np.fft.irfftn(power, length, tuple(range(2, 2 + len(axes))))
    for j, i in enumerate(moving):
        full = np.take(full, np.arange(-most[i], most[i] + 1) % length[j], axis=2 + j)
    for i in range(3):
        if i not in moving:
            full = np.expand_dims(full, 2 + i)
    return full


PAIRS = "t long, u long, d double, c double, soft_d double, soft_c double, dx double, dz double"


def registered(vols: DataFrame, grid: Grid, most: tuple[int, int, int], sigma=(0.0, 0.0, 0.0), tau: float = 0.05, block: int = 32, frame: int | None = None) -> DataFrame:
    """t, u (t > u), d and c: displacement along y (um) and correlation at the best lag (ties to the smaller), their softmax means at
    temperature tau, and the best lag's displacement along x and z. Pairs of flat volumes are left out. `block` time bins are a block."""
    own = vols.withColumn("own", F.floor(F.col("bin") / block))
    blocks = own.select(F.col("own").alias("b")).distinct()
    near = F.lit(True) if frame is None else F.abs(F.col("own") - F.col("b")) <= -(-frame // block) + 1
    # one row for `block` bins: the broadcast side is bounded by the recording's length over block * time_bin
    side = own.join(F.broadcast(blocks), near).select(F.greatest("own", "b").alias("i"), F.least("own", "b").alias("j"), "own", "bin", "voxels")
    shape, size = grid.shape, grid.size

    def run(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        bins, of = table["bin"].to_numpy(), table["own"].to_numpy()
        v = normalised(dense(table["voxels"].to_pylist(), shape, sigma))
        left, right = np.flatnonzero(of == i), np.flatnonzero(of == j)
        live = np.abs(v).sum((1, 2, 3)) > 0
        out = []
        for s in range(0, len(left), 8):  # some first bins at a time bound the lags held
            part = left[s : s + 8]
            r = correlations(v[part], v[right], most)
            lags = [np.arange(-m, m + 1) for m in most]
            flat = r.reshape(*r.shape[:2], -1)
            best = np.round(flat, 9).argmax(2)
            ix, iy, iz = np.unravel_index(best, r.shape[2:])
            w = np.exp((flat - flat.max(2, keepdims=True)) / tau)
            w /= w.sum(2, keepdims=True)
            along = np.broadcast_to(lags[1][None, :, None], r.shape[2:]).ravel()
            a, b = np.meshgrid(part, right, indexing="ij")
            ok = (bins[a] > bins[b]) & live[a] & live[b]
            if frame is not None:
                ok &= bins[a] - bins[b] <= frame
            top = np.take_along_axis(flat, best[..., None], 2)[..., 0]
            out.append([c[ok] for c in (bins[a], bins[b], lags[1][iy] * size[1], top, (w @ along) * size[1], (w * flat).sum(2), lags[0][ix] * size[0], lags[2][iz] * size[2])])
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({c.split()[0]: pa.array(v, pa.int64() if k < 2 else pa.float64()) for k, (c, v) in enumerate(zip(PAIRS.split(", "), cols, strict=True))})

    return side.groupBy("i", "j").applyInArrow(run, PAIRS)
