"""Places and widths of candidates refined by gradients, at fixed assignments.

A spike's captured energy at candidate k is g' P g, with P its packed form and g the unit footprint, the same for all spikes of one
geometry. So the sums of packed forms by candidate and geometry hold all that the error depends on: one aggregation (36 sums, combined
before the shuffle), and every candidate's descent runs on its own few rows, in one group of at most as many rows as there are
geometries. No spike is read again however many steps are taken.

Slopes are exact: with f = g' P g / g' g, df = 2 (P u - (u' P u) u)' dg / |g| for the unit footprint u, and dg follows from the kernel's
derivatives in lateral and axial distance and width, taken by a complex step (to rounding, without cancellation). Steps are
heavy-ball with halving: a step that lowers what is captured is taken back, and momentum starts anew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import evaluate
from tidemark.operators import packed
from tidemark.sources.recording import SLOTS, geometry

ENTRIES = SLOTS * (SLOTS + 1) // 2
LEAST_WIDTH = 0.5


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def inverse_softplus(y: np.ndarray) -> np.ndarray:
    """x with softplus(x) = y > 0."""
    return y + np.log(-np.expm1(-y))


@dataclass
class Learned:
    """Candidates with own places (K, 3) and widths (K,), of one kernel."""

    sites: np.ndarray
    widths: np.ndarray
    kernel: str = "monopole"
    b: float = 2.0
    profiles = (None,)  # one a site: candidate k is site k

    def __len__(self) -> int:
        return len(self.sites)

    def footprints(self, dx: np.ndarray, dy: np.ndarray, lo: int = 0, hi: int | None = None, unit: bool = True) -> np.ndarray:
        s, a = self.sites[lo:hi], self.widths[lo:hi, None]
        r2 = (dx[None] - s[:, :1]) ** 2 + (dy[None] - s[:, 1:2]) ** 2
        g = evaluate(self.kernel, r2, np.broadcast_to(s[:, 2:] ** 2, r2.shape), a, self.b)
        return g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12) if unit else g


def statistics(spikes: DataFrame, omega: np.ndarray, candidates) -> DataFrame:
    """k, cfg, n, energy, captured, p (array: summed packed form) of the spikes at each candidate and geometry."""
    return _summed(packed.forms(spikes, omega), candidates)


def _summed(forms: DataFrame, candidates) -> DataFrame:
    at = packed.assigned(forms, candidates, keep=True)
    j = at.join(F.broadcast(geometry(forms.sparkSession).select("channel", "cfg")), "channel")
    sums = [F.sum(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(ENTRIES)]
    g = j.groupBy("k", "cfg").agg(F.count(F.lit(1)).alias("n"), F.sum("energy").alias("energy"), F.sum("score").alias("captured"), *sums)
    return g.select("k", "cfg", "n", "energy", "captured", F.array(*[f"p{i}" for i in range(ENTRIES)]).alias("p"))


def captured_and_slope(x: np.ndarray, forms: np.ndarray, dx: np.ndarray, dy: np.ndarray, kernel: str, b: float) -> tuple[float, np.ndarray]:
    """What a candidate x = (px, py, pz, softplus^-1(width - LEAST_WIDTH)) captures of summed forms (G, C, C) at contacts (G, C), and the slope."""
    a = LEAST_WIDTH + float(softplus(x[3]))
    r2 = (dx - x[0]) ** 2 + (dy - x[1]) ** 2
    z2, h = np.full_like(r2, x[2] ** 2), 1e-20
    g = evaluate(kernel, r2, z2, a, b)
    by_r2 = evaluate(kernel, r2 + 1j * h, z2 + 0j, a, b).imag / h
    by_z2 = evaluate(kernel, r2 + 0j, z2 + 1j * h, a, b).imag / h
    by_a = evaluate(kernel, r2 + 0j, z2 + 0j, a + 1j * h, b).imag / h
    size = np.maximum(np.linalg.norm(g, axis=1), 1e-12)
    u = g / size[:, None]
    pu = np.einsum("gcd,gd->gc", forms, u)
    got = np.einsum("gc,gc->g", u, pu)
    pull = 2 * (pu - got[:, None] * u) / size[:, None]
    slope = [(pull * by_r2 * -2 * (dx - x[0])).sum(), (pull * by_r2 * -2 * (dy - x[1])).sum(), (pull * by_z2 * 2 * x[2]).sum(), (pull * by_a).sum() / (1 + np.exp(-x[3]))]
    return float(got.sum()), np.array(slope)


def climbed(x: np.ndarray, forms, dx, dy, kernel: str, b: float, steps: int, first: float, move_width: bool) -> tuple[np.ndarray, float, float]:
    """(x, captured before, captured after): never less after."""
    scale = np.array([1.0, 1.0, 1.0, 0.1 if move_width else 0.0])
    now, slope = captured_and_slope(x, forms, dx, dy, kernel, b)
    before, step, speed = now, first, np.zeros(4)
    for _ in range(steps):
        push = slope * scale * scale
        size = np.sqrt((slope * scale * push / np.maximum(scale, 1e-12)).sum())
        if size <= 1e-12 * max(now, 1e-12) or step < 1e-6:
            break
        new_speed = 0.7 * speed + step * push / size
        new = x + new_speed
        got, new_slope = captured_and_slope(new, forms, dx, dy, kernel, b)
        if got > now:
            x, now, slope, speed, step = new, got, new_slope, new_speed, step * 1.1
        else:
            speed, step = np.zeros(4), step / 2
    return x, before, now


def refined(stats: DataFrame, candidates: Learned, steps: int = 120, first: float = 2.0, move_width: bool = True) -> DataFrame:
    """k, n, energy, x, y, z, width, before, after (captured at the old and at the new place) of every candidate that holds spikes."""
    rows = geometry(stats.sparkSession).select("cfg", "dx", "dy").distinct().collect()
    offsets = {r["cfg"]: (np.array(r["dx"]), np.array(r["dy"])) for r in rows}
    i, j, _ = packed.triangle(SLOTS)
    sites, widths, kernel, b = candidates.sites, candidates.widths, candidates.kernel, candidates.b

    def run(key, table):
        k = key[0].as_py()
        flat = table["p"].combine_chunks().flatten().to_numpy().reshape(-1, ENTRIES)
        forms = np.zeros((len(flat), SLOTS, SLOTS))
        forms[:, i, j] = flat
        forms[:, j, i] = flat
        dx, dy = (np.stack([offsets[c][m] for c in table["cfg"].to_pylist()]) for m in (0, 1))
        start = np.append(sites[k], inverse_softplus(np.maximum(widths[k] - LEAST_WIDTH, 1e-6)))
        x, before, after = climbed(start, forms, dx, dy, kernel, b, steps, first, move_width)
        width = LEAST_WIDTH + float(softplus(x[3])) if move_width else float(widths[k])
        row = {"k": k, "n": sum(table["n"].to_pylist()), "energy": sum(table["energy"].to_pylist()), "x": x[0], "y": x[1], "z": abs(x[2]), "width": width, "before": before, "after": after}
        return pa.Table.from_pylist([row], pa.schema([(c, pa.int64() if c in ("k", "n") else pa.float64()) for c in row]))

    return stats.groupBy("k").applyInArrow(run, "k long, n long, energy double, x double, y double, z double, width double, before double, after double")


def start_places(spikes: DataFrame, k: int, how: str = "lattice", seed: int = 0) -> np.ndarray:
    """Places to start from: the lattice nearest k cells, its first k places; or k-means of one-source positions around their anchors.

    Those positions are a few places, so their k-means is that of the places weighted by their spikes. The spikes are read once: KMeans
    reads its rows twice in a task and pairs both readings, and over large tables these were found to differ in length.
    """
    from tidemark.operators.candidates import cells_for, grid

    if how == "lattice":
        wanted = k
        while (g := grid(*cells_for(wanted))).shape[0] < k:
            wanted += max(1, k // 10)
        return g[:k]
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from tidemark.operators.inference import LATTICE, assigned

    held = assigned(spikes).groupBy(F.element_at("top", 1)["n"].alias("n")).agg(F.count(F.lit(1)).alias("spikes")).collect()
    rows = [(*LATTICE[r["n"]], float(r["spikes"])) for r in sorted(held)]
    d = spikes.sparkSession.createDataFrame(rows, "x double, y double, z double, spikes double").coalesce(1)
    d = VectorAssembler(inputCols=["x", "y", "z"], outputCol="v").transform(d)
    centres = np.array(KMeans(featuresCol="v", weightCol="spikes", k=k, seed=seed, initSteps=5).fit(d).clusterCenters())
    return centres[np.lexsort(centres.T[::-1])]


def fitted(spikes: DataFrame, omega: np.ndarray, start: Learned, rounds: int = 4, least: float = 1e-4, **options) -> tuple[Learned, list[float]]:
    """Alternates assignment and refinement; the captured share of every round. Candidates without spikes stay where they are.

    One row a used candidate comes to the driver each round: the model itself, not the data. What is kept for the rounds are the packed
    forms, which are smaller than the waveforms.
    """
    pool = packed.forms(spikes, omega).persist()
    try:
        now, shares = start, []
        for _ in range(rounds):
            stats = _summed(pool, now)
            rows = refined(stats, now, **options).collect()
            energy = max(sum(r["energy"] for r in rows), 1e-300)
            shares += [sum(r["before"] for r in rows) / energy, sum(r["after"] for r in rows) / energy]
            sites, widths = now.sites.copy(), now.widths.copy()
            for r in rows:
                sites[r["k"]], widths[r["k"]] = (r["x"], r["y"], r["z"]), r["width"]
            now = Learned(sites, widths, now.kernel, now.b)
            if shares[-1] - shares[-2] < least:
                break
        return now, shares
    finally:
        pool.unpersist()
