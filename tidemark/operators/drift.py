"""Motion end to end: histograms of depth and log amplitude by time, registration by depth window, solve, choice of a window, scores.

A histogram row is a time bin with its non-empty (depth, amplitude) cells. Pairs of blocks of bins are registered in groups, for all depth
windows at once: cells are weighted by the window's profile, and correlations at all lags along depth are summed over amplitudes. Each
window's pairs are solved by themselves (motion.solved); one window over the whole depth is the rigid motion. The window whose motion follows
the truth best is chosen by its correlation, and rigid and nonrigid rows go to the motion table of ``state``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import motion
from tidemark.session import kept


@dataclass(frozen=True)
class Config:
    """Defaults of the histogram (s, um, log units), windows (um), lags (um) and weights."""

    time_bin: float = 20.0
    y_lo: float = 0.0
    y_hi: float = 320.0
    y_bin: float = 5.0
    amp_bins: int = 8
    amp_lo: float = 0.0
    amp_hi: float = 6.0
    windows: int = 4
    window_sigma: float = 60.0
    most_lag: float = 80.0
    least: float = 0.1
    power: float = 2.0
    frame: int | None = None

    def checked(self) -> Config:
        if min(self.time_bin, self.y_bin, self.window_sigma) <= 0 or self.y_hi <= self.y_lo or self.amp_hi <= self.amp_lo:
            raise ValueError("bins, windows and ranges are positive")
        if min(self.amp_bins, self.windows) < 1 or not 0 < self.most_lag < self.y_hi - self.y_lo:
            raise ValueError("at least one amplitude bin and window, lags shorter than the depth range")
        return self

    @property
    def pixels(self) -> int:
        return int(np.ceil((self.y_hi - self.y_lo) / self.y_bin))

    @property
    def centres(self) -> np.ndarray:
        edge = (self.y_hi - self.y_lo) / self.windows
        return self.y_lo + edge * (np.arange(self.windows) + 0.5)


def histogram(events: DataFrame, c: Config, y: str = "y", amp: str = "amp") -> DataFrame:
    """bin, cells (array of struct<v, w>; v = amplitude bin * pixels + depth pixel): counts; amplitudes beyond the range go to its ends."""
    level = F.floor((F.log(1 + F.abs(F.col(amp))) - c.amp_lo) / ((c.amp_hi - c.amp_lo) / c.amp_bins))
    level = F.greatest(F.lit(0), F.least(level, F.lit(c.amp_bins - 1)))
    pixel = F.floor((F.col(y) - c.y_lo) / c.y_bin)
    d = events.where((F.col(y) >= c.y_lo) & (F.col(y) < c.y_hi)).select(F.floor(F.col("t") / c.time_bin).alias("bin"), (level * c.pixels + pixel).alias("v"))
    d = d.groupBy("bin", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return d.groupBy("bin").agg(F.collect_list(F.struct("v", "w")).alias("cells"))


def profiles(c: Config) -> np.ndarray:
    """(1 + windows, pixels): the rigid window, which is flat, then Gaussian ones around the centres."""
    mid = c.y_lo + c.y_bin * (np.arange(c.pixels) + 0.5)
    local = np.exp(-0.5 * ((mid[None] - c.centres[:, None]) / c.window_sigma) ** 2)
    return np.concatenate([np.ones((1, c.pixels)), local])


def registered(hist: DataFrame, c: Config, block: int = 64) -> DataFrame:
    """win (0: rigid), t, u (t > u), d, c: the best displacement in depth and its correlation, refined between pixels by a parabola."""
    c, shapes, most = c.checked(), profiles(c), int(round(c.most_lag / c.y_bin))
    side = hist.withColumn("own", F.floor(F.col("bin") / block))
    blocks = side.select(F.col("own").alias("b")).distinct()
    near = F.lit(True) if c.frame is None else F.abs(F.col("own") - F.col("b")) <= -(-c.frame // block) + 1
    # one row a block of bins is broadcast
    side = side.join(F.broadcast(blocks), near).select(F.greatest("own", "b").alias("i"), F.least("own", "b").alias("j"), "own", "bin", "cells")

    def run(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        bins, of = table["bin"].to_numpy(), table["own"].to_numpy()
        counts = np.zeros((len(bins), c.amp_bins * c.pixels))
        for k, cells in enumerate(table["cells"].to_pylist()):
            for x in cells:
                counts[k, x["v"]] += x["w"]
        counts = np.log1p(counts).reshape(-1, c.amp_bins, c.pixels)
        left, right = np.flatnonzero(of == i), np.flatnonzero(of == j)
        a, b = np.meshgrid(left, right, indexing="ij")
        ok = bins[a] > bins[b]
        if c.frame is not None:
            ok &= bins[a] - bins[b] <= c.frame
        length, out = c.pixels + most, []
        for win, shape in enumerate(shapes):
            v = counts * shape
            v = v - (v.sum((1, 2)) / (c.amp_bins * shape.sum()))[:, None, None] * shape
            size = np.sqrt((v * v).sum((1, 2)))
            v = v / np.where(size > 1e-12, size, np.inf)[:, None, None]
            f = np.fft.rfft(v, length, axis=2).transpose(2, 0, 1)
            r = np.fft.irfft(np.matmul(f[:, left], np.conj(f[:, right]).transpose(0, 2, 1)), length, axis=0)[np.arange(-most, most + 1) % length]
            best = np.round(r, 9).argmax(0)
            top = np.take_along_axis(r, best[None], 0)[0]
            before, after = (np.take_along_axis(r, np.clip(best + k, 0, 2 * most)[None], 0)[0] for k in (-1, 1))
            bend = before - 2 * top + after
            inner = (best > 0) & (best < 2 * most) & (bend < -1e-12)
            shift = np.where(inner, 0.5 * (before - after) / np.where(inner, bend, 1), 0)
            live = ok & (size[a] > 1e-12) & (size[b] > 1e-12)
            out.append((np.full(int(live.sum()), win), bins[a][live], bins[b][live], ((best - most + shift) * c.y_bin)[live], top[live]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("win", "t", "u", "d", "c"), cols, kinds, strict=True)})

    return side.groupBy("i", "j").applyInArrow(run, "win int, t long, u long, d double, c double")


def estimated(events: DataFrame, c: Config, y: str = "y", amp: str = "amp") -> DataFrame:
    """win, t (s, middle of the bin), p (um, mean 0): rigid motion (window 0) and that of each depth window."""
    # blocks of bins are met in a join and listed beside it: counted once
    hist = kept(histogram(events, c, y, amp), "histogram")
    pairs = motion.weights(registered(hist, c), c.least, c.power, c.frame or 1 << 30)
    return motion.solved(pairs, "win").select("win", ((F.col("t") + 0.5) * c.time_bin).alias("t"), "p")


def piecewise(knots: tuple[tuple[float, float], ...], t: Column) -> Column:
    """The piecewise linear function through knots (t, value), constant beyond them."""
    out = F.lit(float(knots[-1][1]))
    for (t0, v0), (t1, v1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(t <= t1, v0 + (t - t0) * ((v1 - v0) / (t1 - t0))).otherwise(out)
    return F.when(t <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


def scored(track: DataFrame, truth: Column, by: str = "win") -> DataFrame:
    """by, r, gain, rmse, n of each track (by, t, p) against the truth, an expression of t, after both lose their mean; r is null for a
    track that doesn't move."""
    d = track.withColumn("gt", truth)
    both = F.covar_pop("p", "gt")
    r, gain = F.try_divide(both, F.stddev_pop("p") * F.stddev_pop("gt")), F.try_divide(both, F.var_pop("gt"))
    off = F.col("p") - F.col("gt")
    return d.groupBy(by).agg(r.alias("r"), gain.alias("gain"), F.sqrt(F.greatest(F.avg(off * off) - F.pow(F.avg(off), 2), F.lit(0.0))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def best_window(scores: DataFrame, by: str = "win") -> DataFrame:
    """The nonrigid window with the highest correlation; ties to the first."""
    w = Window.orderBy(F.desc_nulls_last("r"), by)
    return scores.where(F.col(by) > 0).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def clamped(events: DataFrame, lo: float, hi: float, y: str = "y", margin: float = 1e-3) -> DataFrame:
    """Events with depths held inside (lo, hi): the control in which drift beyond the range can't be seen."""
    return events.withColumn(y, F.least(F.greatest(F.col(y), F.lit(lo + margin)), F.lit(hi - margin)))


def metrics(events: DataFrame, c: Config, truth: Column, bounds: tuple[float, float] | None = None, y: str = "y", amp: str = "amp") -> DataFrame:
    """kind (rigid, nonrigid, clamped), win, r, gain, rmse, n: scores of the rigid motion, of the best window, and of the rigid motion of
    clamped events, as one table."""
    own = scored(estimated(events, c, y, amp), truth)
    rows = own.where("win = 0").select(F.lit("rigid").alias("kind"), "*").unionByName(best_window(own).select(F.lit("nonrigid").alias("kind"), "*"))
    if bounds:
        held = scored(estimated(clamped(events, *bounds, y), c, y, amp).where("win = 0"), truth)
        rows = rows.unionByName(held.select(F.lit("clamped").alias("kind"), "*"))
    return rows
