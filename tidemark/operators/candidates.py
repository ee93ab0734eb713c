"""Candidate dictionaries: lattices of places, grids of profiles, and their product as a table."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.kernels import DIRECTED, ONE, SHAPED, WIDTHS, evaluate

#: Extents of the default volume (um): half widths in x and y, least and largest depth.
VOLUME = (90.0, 60.0, (4.0, 128.0))
#: The wide lattice: half width in x and y, least and largest depth.
WIDE = (150.0, 1.0, 300.0)


def cells_for(wanted: int, volume=VOLUME) -> tuple[int, int, int]:
    """Numbers of levels in x, y and z with a product as near to `wanted` as near-cubic cells allow.

    An edge h gives round(extent / h) + 1 levels in each direction, 2 at least. Edges from 0.55 to 1.8 times that of a cube of the
    volume per cell are tried in 260 steps; of equally near products the smallest edge wins.
    """
    extent = np.array([2 * volume[0], 2 * volume[1], volume[2][1] - volume[2][0]])
    edge = np.cbrt(extent.prod() / max(wanted, 1)) * np.linspace(0.55, 1.8, 260)
    levels = np.maximum(2, np.rint(extent[None] / edge[:, None]).astype(int) + 1)
    return tuple(int(v) for v in levels[np.abs(levels.prod(1) - wanted).argmin()])


def grid(nx: int, ny: int, nz: int, volume=VOLUME) -> np.ndarray:
    """Places (nx * ny * nz, 3): x slowest, z fastest; x and y evenly spaced, z geometrically."""
    axes = [np.linspace(-volume[0], volume[0], nx), np.linspace(-volume[1], volume[1], ny), np.geomspace(*volume[2], nz)]
    return np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)


def lattice(n: int) -> np.ndarray:
    """n ** 3 places of the wide lattice."""
    half, lo, hi = WIDE
    return grid(n, n, n, (half, half, (lo, hi)))


def profiles(kernels: list[str], scales: int = 10, directed: int = 0, shapes: tuple[float, ...] = (2.0,), lo: float = 1.0, hi: float = 512.0) -> list[tuple[str, float, float]]:
    """(kernel, a, b) in the order of the kernels: geometric widths; crossed with `shapes` where the kernel has a shape; a square grid of
    lateral and axial widths (`directed` levels, `scales` if 0) where it has a direction. b is 2 where the kernel doesn't read it."""
    out: list[tuple[str, float, float]] = []
    for name in kernels:
        widths = [float(w) for w in np.geomspace(lo, hi, scales)]
        if WIDTHS[name] == DIRECTED:
            widths = [float(w) for w in np.geomspace(lo, hi, directed or scales)]
            out += [(name, a, b) for a in widths for b in widths]
        elif WIDTHS[name] == SHAPED:
            out += [(name, a, float(b)) for a in widths for b in shapes]
        else:
            assert WIDTHS[name] == ONE
            out += [(name, a, 2.0) for a in widths]
    return out


@dataclass
class Candidates:
    """Candidate k is site k // profiles at profile k % profiles."""

    sites: np.ndarray
    profiles: list[tuple[str, float, float]] = field(default_factory=lambda: [("monopole", 15.0, 2.0)])

    def __len__(self) -> int:
        return len(self.sites) * len(self.profiles)

    def footprints(self, dx: np.ndarray, dy: np.ndarray, lo: int = 0, hi: int | None = None, unit: bool = True) -> np.ndarray:
        """(hi - lo, contacts): candidates lo..hi-1 at contacts with offsets dx, dy from the anchor, of unit length."""
        hi, p = len(self) if hi is None else hi, len(self.profiles)
        first, last = lo // p, -(-hi // p)
        s = self.sites[first:last]
        r2 = (dx[None] - s[:, :1]) ** 2 + (dy[None] - s[:, 1:2]) ** 2
        z2 = np.broadcast_to(s[:, 2:] ** 2, r2.shape)
        g = np.stack([evaluate(name, r2, z2, a, b) for name, a, b in self.profiles], 1).reshape(-1, len(dx))[lo - first * p : hi - first * p]
        return g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12) if unit else g

    def table(self, spark: SparkSession) -> DataFrame:
        """k, site, profile, x, y, z, kernel, a, b; sites and profiles are parameters of the model, joined in the cluster."""
        sites = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(self.sites)], "site long, x double, y double, z double")
        kinds = spark.createDataFrame([(j, *p) for j, p in enumerate(self.profiles)], "profile long, kernel string, a double, b double")
        k = spark.range(len(self)).selectExpr("id as k", f"id div {len(self.profiles)} as site", f"id % {len(self.profiles)} as profile")
        return k.join(sites, "site").join(kinds, "profile").select("k", "site", "profile", "x", "y", "z", "kernel", "a", "b")
