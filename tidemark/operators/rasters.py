"""Histograms, rasters and voxel grids: bucket expressions and one aggregation that combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """Bin of n equal ones over [lo, hi]; the last is closed on the right, outside is null."""
    i = F.least(F.floor((x - lo) / ((hi - lo) / n)), F.lit(n - 1))
    return F.when((x >= lo) & (x <= hi), i).cast("int")


def open_bin(x: Column, lo: float, width: float, n: int) -> Column:
    """Half-open bins of a width; outside is null."""
    i = F.floor((x - lo) / width)
    return F.when((i >= 0) & (i < n), i).cast("int")


def raster(df: DataFrame, bins: dict[str, Column], **sums: Column) -> DataFrame:
    """Sums over the cells named by bins; rows in no cell are left out."""
    d = df.select(*[c.alias(k) for k, c in bins.items()], *[c.alias(k) for k, c in sums.items()])
    d = d.where(" and ".join(f"{k} is not null" for k in bins))
    return d.groupBy(*bins).agg(*[F.sum(k).alias(k) for k in sums], F.count(F.lit(1)).alias("n"))


def hexagon(x: Column, y: Column, size: float) -> tuple[Column, Column, Column]:
    """(lattice, column, row) of the hexagon of that width: the nearer centre of two offset rectangular lattices."""
    u, v = x / size, y / (size * 3**0.5)
    i0, j0 = F.floor(u + 0.5), F.floor(v + 0.5)
    i1, j1 = F.floor(u), F.floor(v)
    d0 = F.pow(u - i0, 2) + 3 * F.pow(v - j0, 2)
    d1 = F.pow(u - i1 - 0.5, 2) + 3 * F.pow(v - j1 - 0.5, 2)
    first = d0 < d1
    return F.when(first, 0).otherwise(1), F.when(first, i0).otherwise(i1), F.when(first, j0).otherwise(j1)


def filled(counts: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """counts with zero rows for the keys of the domain it lacks."""
    return domain.join(counts, keys, "left").na.fill(0)
