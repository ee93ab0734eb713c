"""Voxel geometry: quantised anchors, patches, blurs with three boundary rules, and read-outs of heat maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantised(x: Column, step: float) -> Column:
    """The nearest multiple of step; halves go to the even one."""
    return F.bround(x / step) * step


def inside(x: Column, lo: float, hi: float, margin: float = 1e-3) -> Column:
    """x held inside [lo, hi] by a margin."""
    return F.least(F.greatest(x, F.lit(lo + margin)), F.lit(hi - margin))


def patches(sums: DataFrame, channels: DataFrame, step: float, reach: int, lo: int, hi: int) -> DataFrame:
    """bin, iy, w: weights by (bin, channel) spread over the 2 * reach + 1 pixels around each channel's own, as a tent; what falls
    outside lo <= iy < hi is summed under iy = -1. The weights are summed before, so the spread is over channels, not spikes."""
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(1 - abs(k) / (reach + 1)).alias("f")) for k in range(-reach, reach + 1)])
    p = channels.select("channel", F.bround(F.col("y") / step).cast("long").alias("iy"), F.explode(offsets).alias("o"))
    p = p.select("channel", (F.col("iy") + F.col("o.k")).alias("iy"), F.col("o.f").alias("f"))
    at = F.when((F.col("iy") >= lo) & (F.col("iy") < hi), F.col("iy")).otherwise(F.lit(-1))
    j = sums.join(F.broadcast(p), "channel")
    return j.groupBy("bin", at.alias("iy")).agg(F.sum(F.col("w") * F.col("f")).alias("w"))


def blurred(grid: DataFrame, by: list[str], axis: str, value: str, sigma: float, n: int, rule: str, out: str = "smooth") -> DataFrame:
    """Gaussian blur along an axis of pixels 0..n-1 (sigma in pixels, radius round(3 sigma)); empty pixels are 0 and appear.

    rule: "zero" - nothing beyond the ends; "reflect" - the grid mirrored at its ends, ends repeated; "nearest" - end values held.
    Each pixel sends its share to its neighbours by an equality, so the rows moved are pixels times the kernel's width.
    """
    if sigma <= 0.05:
        return grid.select(*by, axis, F.col(value).alias(out))
    radius = round(3 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    taps = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(v / sum(kernel)).alias("f")) for k, v in zip(range(-radius, radius + 1), kernel, strict=True)])
    keys = grid.select(*by).distinct()
    target = keys.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("at"), F.explode(F.array(F.lit(1))).alias("_")).drop("_")
    pull = target.select(*by, "at", F.explode(taps).alias("o")).select(*by, "at", (F.col("at") + F.col("o.k")).alias("src"), F.col("o.f").alias("f"))
    if rule == "reflect":
        m = F.pmod(F.col("src"), F.lit(2 * n))
        pull = pull.withColumn("src", F.when(m < n, m).otherwise(2 * n - 1 - m))
    elif rule == "nearest":
        pull = pull.withColumn("src", F.least(F.greatest("src", F.lit(0)), F.lit(n - 1)))
    have = grid.select(*by, F.col(axis).cast("long").alias("src"), F.col(value).alias("v"))
    j = pull.join(have, [*by, "src"], "left")
    return j.groupBy(*by, F.col("at").alias(axis)).agg(F.coalesce(F.sum(F.col("v") * F.col("f")), F.lit(0.0)).alias(out))


def expectation(cells: DataFrame, by: str, axis: str, value: str, around: int | None = None) -> DataFrame:
    """by, mean: weighted mean pixel of each map; with `around`, over the pixels at most that far from the largest (ties: smallest)."""
    c = cells
    if around is not None:
        top = c.groupBy(by).agg(F.max(F.struct(F.round(value, 9).alias("v"), (-F.col(axis)).alias("neg"))).alias("m")).select(by, (-F.col("m.neg")).alias("mode"))
        c = c.join(top, by).where(F.abs(F.col(axis) - F.col("mode")) <= around)
    return c.groupBy(by).agg((F.sum(F.col(axis) * F.col(value)) / F.sum(value)).alias("mean"))
