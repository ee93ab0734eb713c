"""Motion over time: pairwise comparison of binned activity, displacement solve, correction and scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = "t long, u long, d double, c double"


def profiles(spikes: DataFrame, time_bin: float, y: str, y_bin: float, amp: str = "amp") -> DataFrame:
    """bin, iy, w: activity by time bin and depth pixel."""
    d = spikes.select(F.floor(F.col("t") / time_bin).alias("bin"), F.floor(F.col(y) / y_bin).alias("iy"), F.col(amp).alias("w"))
    return d.groupBy("bin", "iy").agg(F.sum("w").alias("w"))


def ladder(spikes: DataFrame, time_bin: float, depths: dict[float, Column], y_bin: float, amp: str = "amp") -> DataFrame:
    """k, bin, iy, w: the profiles of several versions of the depth, by their keys, of one pass over the spikes."""
    pixels = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.floor(y / y_bin).alias("iy")) for k, y in depths.items()])
    d = spikes.select(F.floor(F.col("t") / time_bin).alias("bin"), F.col(amp).alias("w"), F.explode(pixels).alias("p"))
    return d.groupBy("p.k", "bin", "p.iy").agg(F.sum("w").alias("w"))


def lagged_pairs(prof: DataFrame, most: int, lo: int, hi: int, frame: int | None = None, block: int = 64) -> DataFrame:
    """t, u, lag, r: zero-mean normalised correlation of every two time bins t > u (at most `frame` apart, if given) at each lag.

    A profile is dense over the pixels lo <= iy < hi: pixels without activity count in its mean and norm. With v the profile less
    its mean over its norm, r = sum_y v_t(y + lag) v_u(y), nothing beyond the grid. Bins are dealt to blocks, and each pair of
    blocks is one group of at most 2 * block profiles, whatever the number of bins.
    """
    cells = prof.where((F.col("iy") >= lo) & (F.col("iy") < hi)).groupBy("bin").agg(F.collect_list(F.struct("iy", "w")).alias("cells"))
    blocks = cells.select(F.floor(F.col("bin") / block).alias("b")).distinct()
    side = cells.withColumn("own", F.floor(F.col("bin") / block))
    near = F.lit(True) if frame is None else F.abs(F.col("own") - F.col("b")) <= -(-frame // block) + 1
    # one row a block of bins is broadcast: bins over `block`
    side = side.join(F.broadcast(blocks), near).select(F.greatest("own", "b").alias("i"), F.least("own", "b").alias("j"), "bin", "own", "cells")

    def run(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        bins, own = table["bin"].to_numpy(), table["own"].to_numpy()
        v = np.zeros((len(bins), hi - lo))
        for k, cells in enumerate(table["cells"].to_pylist()):
            for c in cells:
                v[k, c["iy"] - lo] += c["w"]
        v -= v.mean(1, keepdims=True)
        norm = np.sqrt((v * v).sum(1))
        v /= np.where(norm > 0, norm, 1)[:, None]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        x, y, width = v[left], v[right], hi - lo
        a, b = np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij")
        ok = (bins[left][a] > bins[right][b]) & ((norm[left][a] > 0) & (norm[right][b] > 0))
        if frame is not None:
            ok &= bins[left][a] - bins[right][b] <= frame
        out = []
        for lag in range(-most, most + 1):
            r = x[:, max(lag, 0) : width + min(lag, 0)] @ y[:, max(-lag, 0) : width - max(lag, 0)].T
            out.append((bins[left][a][ok], bins[right][b][ok], np.full(int(ok.sum()), lag), r[ok]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"t": pa.array(cols[0], pa.int64()), "u": pa.array(cols[1], pa.int64()), "lag": pa.array(cols[2], pa.int32()), "r": pa.array(cols[3])})

    return side.groupBy("i", "j").applyInArrow(run, "t long, u long, lag int, r double")


def hard_pairs(lagged: DataFrame, y_bin: float) -> DataFrame:
    """Largest correlation and its displacement for each pair; ties to the smaller lag."""
    best = F.max(F.struct(F.round("r", 9).alias("r"), (-F.col("lag")).alias("neg"))).alias("b")
    return lagged.groupBy("t", "u").agg(best).select("t", "u", (-F.col("b.neg") * F.lit(float(y_bin))).alias("d"), F.col("b.r").alias("c"))


def soft_pairs(lagged: DataFrame, y_bin: float, tau: float) -> DataFrame:
    """Softmax over lags at temperature tau: expected displacement and correlation."""
    w = F.exp((F.col("r") - 1) / tau)
    return lagged.groupBy("t", "u").agg((F.sum(w * F.col("lag")) / F.sum(w) * y_bin).alias("d"), (F.sum(w * F.col("r")) / F.sum(w)).alias("c"))


def reciprocal(pairs: DataFrame, hard: bool) -> DataFrame:
    """Both directions of every pair: c averaged, d antisymmetric (soft) or the smaller magnitude of the two (hard; ties: own).
    A pair without its reverse stands for both; a bin with itself has d = 0."""
    here = pairs.select("t", "u", "d", "c")
    back = pairs.select(F.col("u").alias("t"), F.col("t").alias("u"), (-F.col("d")).alias("d2"), F.col("c").alias("c2"))
    j = here.join(back, ["t", "u"], "full")
    one, two = F.coalesce("d", "d2"), F.coalesce("d2", "d")
    d = F.when(F.abs(one) <= F.abs(two), one).otherwise(two) if hard else (one + two) / 2
    d = F.when(F.col("t") == F.col("u"), F.lit(0.0)).otherwise(d)
    return j.select("t", "u", d.alias("d"), ((F.coalesce("c", "c2") + F.coalesce("c2", "c")) / 2).alias("c"))


def weights(pairs: DataFrame, least: float, power: float, frame: int) -> DataFrame:
    return pairs.where((F.abs(F.col("t") - F.col("u")) <= frame) & (F.col("t") != F.col("u"))).withColumn("w", F.pow(F.greatest(F.col("c") - least, F.lit(0.0)), F.lit(power)))


def solve(t: np.ndarray, u: np.ndarray, d: np.ndarray, w: np.ndarray, smooth: float = 1.0, ridge: float = 1e-6, rounds: int = 5, huber: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions p with p_t - p_u close to d: weighted Laplacian, smoothness, ridge; mean 0. One solve, and `rounds` more with
    weights that fall where a pair is off by over `huber`. Dense: a recording has at most some thousand time bins."""
    bins, at = np.unique(np.concatenate([t, u]), return_inverse=True)
    n, i, j = len(bins), at[: len(t)], at[len(t) :]
    diff = np.diff(np.eye(n), axis=0)
    p, now = np.zeros(n), w.copy()
    for _ in range(rounds + 1):
        a = smooth * diff.T @ diff + ridge * np.eye(n)
        np.add.at(a, (i, i), 2 * now)
        np.add.at(a, (j, j), 2 * now)
        np.add.at(a, (i, j), -2 * now)
        np.add.at(a, (j, i), -2 * now)
        rhs = np.bincount(i, 2 * now * d, n) - np.bincount(j, 2 * now * d, n)
        p = np.linalg.solve(a, rhs)
        p -= p.mean()
        now = w * np.minimum(1, huber / np.maximum(np.abs(p[i] - p[j] - d), 1e-12))
    return bins, p


def solved(pairs: DataFrame, by: str | None = None, **options) -> DataFrame:
    """Motion (t, p) of each group: pairs (t, u, d, w) of one recording or depth window are a bounded frame of time bins."""
    if by is None:
        pairs, by = pairs.withColumn("win", F.lit(0)), "win"

    def run(key, table):
        a = [table[c].to_numpy() for c in ("t", "u", "d", "w")]
        bins, p = solve(*a, **options)
        return pa.table({by: pa.array([key[0].as_py()] * len(bins), pa.int32()), "t": pa.array(bins, pa.int64()), "p": pa.array(p)})

    return pairs.select(F.col(by).cast("int").alias(by), "t", "u", "d", "w").groupBy(by).applyInArrow(run, f"{by} int, t long, p double")


def flatness(spikes: DataFrame, y: str, time_bins: int, y_lo: float, y_hi: float, y_bins: int, t_end: float) -> DataFrame:
    """Standard deviation over time bins of the centre of mass in depth, from bin midpoints."""
    from tidemark.operators.rasters import closed_bin

    d = spikes.select(closed_bin(F.col("t"), 0.0, t_end, time_bins).alias("b"), closed_bin(F.col(y), y_lo, y_hi, y_bins).alias("i")).where("b is not null and i is not null")
    mid = y_lo + (F.col("i") + 0.5) * ((y_hi - y_lo) / y_bins)
    by = d.groupBy("b").agg(F.avg(mid).alias("com"))
    return by.agg(F.stddev_pop("com").alias("flatness"), F.count(F.lit(1)).alias("bins"))


def simple_score(trace: DataFrame) -> DataFrame:
    """Of (p, gt): correlation, gain, error and ranges, without detrending."""
    return trace.agg(
        F.corr("p", "gt").alias("r"),
        (F.covar_pop("p", "gt") / F.var_pop("gt")).alias("gain"),
        F.sqrt(F.avg(F.pow((F.col("p") - F.col("gt")), 2)) - F.pow(F.avg(F.col("p") - F.col("gt")), 2)).alias("rmse"),
        (F.max("p") - F.min("p")).alias("p_range"),
        (F.max("gt") - F.min("gt")).alias("gt_range"),
    )


def step_score(trace: DataFrame) -> DataFrame:
    """Correlation of first differences in the order of t; trace has one row a time bin."""
    w = Window.orderBy("t")
    d = trace.select((F.col("p") - F.lag("p").over(w)).alias("dp"), (F.col("gt") - F.lag("gt").over(w)).alias("dg"))
    return d.where("dp is not null").agg(F.corr("dp", "dg").alias("step_r"), F.count(F.lit(1)).alias("n"))


def detrended_score(trace: DataFrame) -> tuple[float, float, float]:
    """(r, gain, residual) of p against gt after a least-squares parabola in t is taken off both; from sums, zeros if flat."""
    names = ["one", "t", "t2", "p", "gt"]
    d = trace.select(F.lit(1.0).alias("one"), (F.col("t") / 1000).alias("t"), F.pow(F.col("t") / 1000, 2).alias("t2"), "p", "gt")
    sums = d.agg(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).first()
    g = np.array([x or 0.0 for x in sums]).reshape(5, 5)
    base, own = g[:3, :3], g[3:, 3:]
    left = own - g[3:, :3] @ np.linalg.pinv(base) @ g[:3, 3:]
    pp, pg, gg = left[0, 0], left[0, 1], left[1, 1]
    if pp <= 1e-12 or gg <= 1e-12:
        return 0.0, 0.0, 0.0
    return float(pg / np.sqrt(pp * gg)), float(pg / gg), float(np.sqrt(max(pp - pg * pg / gg, 0) / max(g[0, 0], 1)))
