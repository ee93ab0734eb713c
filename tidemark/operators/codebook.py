"""Codebooks of shapes with lags: one job returns the sums of a pass, small solves update all atoms, trials are kept if the error falls.

A pass finds every spike's sources (greedy pursuit, one atom at one lag each, or a place with free coefficients) and sums, inside
Arrow tasks, what an update needs: for each atom the amplitude-weighted waveforms under its sources' footprints with their lags taken back,
and the amplitudes; the scatter of the waveforms under the footprints; error and energy. Those are shapes x samples numbers a task,
whatever the number of spikes. Three updates:

* ``free``: the leading directions of the scatter (orthonormal);
* ``procrustes``: the orthonormal rows nearest the atoms' sums, or those rows each of unit length;
* ``cone``: atoms within an angle of their prototype; prototypes are the leading direction of their atoms by weight, with alternating
  polarity, and atoms are brought into the moved cones again.

A proposal is blended with the codebook before (1, 1/2, 1/4, 1/8) until the error doesn't rise; if none helps, the fit ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import KERNELS
from tidemark.operators import solvers
from tidemark.operators.inference import LATTICE, SOURCES, Pursuit, by_geometry, centred, shapes_by_channel, shift_bank
from tidemark.operators.learning import leading, scatter
from tidemark.sources.recording import SAMPLES


@dataclass(frozen=True)
class Config:
    """What is fitted. ``resolved`` fills in what follows from the rest and refuses contradictions."""

    sources: int = 4
    shapes: int = 4
    kernel: str = "monopole"
    most_lag: int = 1
    shape: str = "onehot"  # or "free"
    nonnegative: bool | None = None
    prototypes: int = 2  # 0: no cones
    cone: float = 35.0
    orthonormal: bool = False
    shortlist: int = 0
    apart: float = 4.0
    min_gain: float = 0.0
    rounds: int = 12

    def resolved(self) -> Config:
        if self.kernel not in KERNELS:
            raise ValueError(f"unknown kernel {self.kernel!r}: one of {sorted(KERNELS)}")
        if self.shape not in ("free", "onehot"):
            raise ValueError("shape is 'free' or 'onehot'")
        if min(self.sources, self.shapes) < 1 or min(self.most_lag, self.prototypes) < 0:
            raise ValueError("sources and shapes are 1 or more, lags and prototypes 0 or more")
        if self.shape == "free":
            if self.nonnegative:
                raise ValueError("free coefficients have no sign to constrain: leave nonnegative out or use shape='onehot'")
            # lags and cones belong to single atoms
            return replace(self, nonnegative=False, prototypes=0, most_lag=0, orthonormal=True)
        if self.prototypes and self.orthonormal:
            raise ValueError("orthonormal atoms can't all lie in the cones of a few prototypes: choose one")
        if self.prototypes > self.shapes:
            raise ValueError("more prototypes than shapes")
        return replace(self, nonnegative=True if self.nonnegative is None else self.nonnegative)

    def tag(self) -> str:
        """A short name that differs wherever the model does."""
        c = self.resolved()
        parts = [f"u{c.shape[0]}", c.kernel[:5], f"M{c.shapes}", f"R{c.sources}"]
        parts += [f"s{c.most_lag}"] if c.most_lag else []
        parts += [f"P{c.prototypes}c{int(c.cone)}"] if c.prototypes else []
        parts += ["orth"] if c.orthonormal and c.shape == "onehot" else []
        parts += ["signed"] if c.shape == "onehot" and not c.nonnegative else []
        return "_".join(parts)


@dataclass
class Sums:
    """What one pass returns."""

    atoms: np.ndarray  # (M, T)
    weight: np.ndarray  # (M,)
    scatter: np.ndarray  # (T, T)
    sse: float
    energy: float

    @property
    def nmse(self) -> float:
        return self.sse / max(self.energy, 1e-300)


@dataclass
class Codebook:
    config: Config
    omega: np.ndarray
    prototypes: np.ndarray = field(default_factory=lambda: np.zeros((0, SAMPLES)))
    history: list[dict] = field(default_factory=list)

    @property
    def owner(self) -> np.ndarray:
        """The prototype of each atom: they take turns."""
        return np.arange(len(self.omega)) % max(1, len(self.prototypes))


def unshifted(rows: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Rows (B, T) moved back by their lags, zeros at the open end."""
    at = np.arange(rows.shape[1])[None] + lag[:, None]
    inside = (at >= 0) & (at < rows.shape[1])
    return np.where(inside, np.take_along_axis(rows, np.clip(at, 0, rows.shape[1] - 1), 1), 0.0)


def _pursuit(h: np.ndarray, omega: np.ndarray, c: Config, places: np.ndarray) -> Pursuit:
    return Pursuit(h, places, shift_bank(omega, c.most_lag), 2 * c.most_lag + 1, c.shape == "free", c.shortlist, not c.nonnegative)


def passed(spikes: DataFrame, omega: np.ndarray, config: Config, shapes: np.ndarray, lattice=None) -> Sums:
    """One job over the spikes: the sums of their sources under this codebook."""
    c, places, lags = config.resolved(), np.array(lattice or LATTICE), 2 * config.resolved().most_lag + 1
    (m, t), (of, first) = omega.shape, by_geometry(shapes)

    def run(batches):
        atoms, weight, spread, sse, energy = np.zeros((m, t)), np.zeros(m), np.zeros((t, t)), 0.0, 0.0
        for batch in batches:
            kind, y = of[batch.column(0).to_numpy()], centred(batch.column(1))
            for g in np.unique(kind):
                own, ch = y[kind == g], first[g]
                place, choice, coef, got = _pursuit(shapes[ch], omega, c, places).run(own, c.sources, c.min_gain, c.apart)
                e = float((own * own).sum())
                energy, sse = energy + e, sse + e - float(got.sum())
                i, r = np.nonzero(place >= 0)
                under = np.einsum("sc,sct->st", shapes[ch].T[place[i, r]], own[i])
                spread += under.T @ under
                if c.shape == "onehot":
                    a, q = coef[i, r, 0], choice[i, r] // lags
                    np.add.at(atoms, q, a[:, None] * unshifted(under, choice[i, r] % lags - c.most_lag))
                    np.add.at(weight, q, np.abs(a))
        flat = np.concatenate([[sse, energy], weight, atoms.ravel(), spread.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    sums = spikes.select("channel", "w").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(2 + m + m * t + t * t)
    for r in sums:
        v[r["i"]] = r["v"]
    return Sums(v[2 + m : 2 + m + m * t].reshape(m, t), v[2 : 2 + m], v[2 + m + m * t :].reshape(t, t), float(v[0]), float(v[1]))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def polar(x: np.ndarray) -> np.ndarray:
    """The matrix with orthonormal rows nearest x."""
    u, _, v = np.linalg.svd(x, full_matrices=False)
    return u @ v


def proposal(book: Codebook, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
    """(atoms, prototypes) that the sums of a pass ask for."""
    c = book.config.resolved()
    if c.shape == "free":
        return leading(sums.scatter, c.shapes), book.prototypes
    if not c.prototypes:
        new = polar(sums.atoms)
        return (new if c.orthonormal else unit_rows(new)), book.prototypes
    atoms, prototypes = book.omega.copy(), book.prototypes.copy()
    used = np.linalg.norm(sums.atoms, axis=1) > 0
    for p in range(len(prototypes)):
        own = np.flatnonzero((book.owner == p) & used)
        atoms[own] = solvers.project_cone(sums.atoms[own], prototypes[p], c.cone)
    for p in range(len(prototypes)):
        own = np.flatnonzero(book.owner == p)
        prototypes[p] = leading(np.einsum("qt,qu,q->tu", atoms[own], atoms[own], np.maximum(sums.weight[own], 1e-9) ** 2), 1)[0]
    prototypes = unit_rows(solvers.polarised(prototypes))
    for p in range(len(prototypes)):
        own = np.flatnonzero(book.owner == p)
        atoms[own] = solvers.project_cone(atoms[own], prototypes[p], c.cone)
    return atoms, prototypes


def blended(book: Codebook, atoms: np.ndarray, prototypes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """A codebook `share` of the way to the proposal that still satisfies the configuration."""
    if share == 1:
        return atoms, prototypes
    c = book.config.resolved()
    mixed = (1 - share) * book.omega + share * atoms
    if c.orthonormal:
        return polar(mixed), prototypes
    if not c.prototypes:
        return unit_rows(mixed), prototypes
    axes = unit_rows((1 - share) * book.prototypes + share * prototypes)
    out = unit_rows(mixed)
    for p in range(len(axes)):
        own = np.flatnonzero(book.owner == p)
        out[own] = solvers.project_cone(out[own], axes[p], c.cone)
    return out, axes


def peak_means(spikes: DataFrame) -> np.ndarray:
    """(2, T): mean peak-centred waveform of spikes whose largest excursion is positive, and of the others; from sums, unit length."""
    half = SAMPLES // 2

    def run(batches):
        total = np.zeros((2, SAMPLES))
        for batch in batches:
            w = _peaked(centred(batch.column(0)), half)
            up = w[:, half] > 0
            total += np.stack([w[up].sum(0), w[~up].sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * SAMPLES), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    v = np.zeros(2 * SAMPLES)
    for r in spikes.select("w").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        v[r["i"]] = r["v"]
    return unit_rows(v.reshape(2, SAMPLES))


def _peaked(y: np.ndarray, half: int) -> np.ndarray:
    """Each spike's waveform on its strongest channel, rolled so that its largest excursion comes at sample `half`."""
    w = y[np.arange(len(y)), np.abs(y).max(2).argmax(1)]
    by = half - np.abs(w).argmax(1)
    return np.take_along_axis(w, (np.arange(w.shape[1])[None] - by[:, None]) % w.shape[1], 1)


def smallest_by_hash(spikes: DataFrame, count: int) -> DataFrame:
    """The `count` spikes of smallest (hash of spike_id, spike_id). An ordered limit would send up to `count` waveforms of every task to the
    driver; here those whose hash is small enough are found by a narrow scan first, and hardly more than `count` are ever sorted."""
    total, hashed = spikes.count(), F.xxhash64("spike_id")
    share = min(1.0, 1.1 * count / max(total, 1))
    while share < 1:
        some = spikes.where(hashed < F.lit(int(-(1 << 63) + share * (1 << 64))))
        if some.count() >= count:
            return some.orderBy(hashed, "spike_id").limit(count)
        share = min(1.0, 2 * share)
    return spikes.orderBy(hashed, "spike_id").limit(count)


def seeded(spikes: DataFrame, config: Config, sample: int = 4000) -> Codebook:
    """A codebook to start from: leading directions of all waveforms; with cones, prototypes from means of both polarities and
    atoms from spherical k-means of at most `sample` peak-centred waveforms (the smallest by hash of their id)."""
    c = config.resolved()
    if not c.prototypes:
        return Codebook(config, leading(scatter(spikes), c.shapes))
    means = peak_means(spikes)
    prototypes = np.concatenate([means, np.tile(means, (c.prototypes, 1))])[: c.prototypes]
    prototypes = unit_rows(solvers.polarised(np.where(np.abs(prototypes).sum(1, keepdims=True) > 0, prototypes, leading(scatter(spikes), 1)[0])))
    rows = smallest_by_hash(spikes, sample).select("w").collect()
    y = np.array([r["w"] for r in rows]).reshape(len(rows), -1, SAMPLES)
    w = _peaked(y - y.mean(2, keepdims=True), SAMPLES // 2) if len(rows) else np.zeros((0, SAMPLES))
    omega = np.zeros((c.shapes, SAMPLES))
    owner = np.arange(c.shapes) % c.prototypes
    for p in range(c.prototypes):
        own, group = np.flatnonzero(owner == p), w[(w[:, SAMPLES // 2] > 0) == (p % 2 == 0)]
        group = group[np.linalg.norm(group, axis=1) > 0]
        centres = solvers.spherical_kmeans(group, len(own), seed=p)[0] if len(group) > len(own) else np.concatenate([group, np.tile(prototypes[p], (len(own), 1))])[: len(own)]
        omega[own] = solvers.project_cone(centres, prototypes[p], c.cone)
    return Codebook(config, omega, prototypes)


def fitted(spikes: DataFrame, config: Config, start: Codebook | None = None, least: float = 1e-5) -> Codebook:
    """Alternates passes and updates; the pool is persisted while it lasts. history: iteration, share of the proposal, nmse."""
    c = config.resolved()
    pool = spikes.select("spike_id", "channel", "w").persist()
    try:
        book = start or seeded(pool, config)
        shapes = shapes_by_channel(spikes.sparkSession, c.kernel)
        sums = passed(pool, book.omega, c, shapes)
        book.history = [{"iteration": 0, "share": 1.0, "nmse": sums.nmse}]
        for i in range(1, c.rounds + 1):
            target, now = proposal(book, sums), book.history[-1]["nmse"]
            for share in (1.0, 0.5, 0.25, 0.125):
                omega, prototypes = blended(book, *target, share)
                after = passed(pool, omega, c, shapes)
                if after.nmse <= now:
                    break
            else:
                break
            book, sums = Codebook(config, omega, prototypes, [*book.history, {"iteration": i, "share": share, "nmse": after.nmse}]), after
            if now - after.nmse < least:
                break
        return book
    finally:
        pool.unpersist()


def explained(spikes: DataFrame, book: Codebook) -> DataFrame:
    """The sources of spikes under a codebook: the columns of inference.sources, one narrow stage."""
    c, lags = book.config.resolved(), 2 * book.config.resolved().most_lag + 1
    shapes, places, omega = shapes_by_channel(spikes.sparkSession, c.kernel), np.array(LATTICE), book.omega
    of, first = by_geometry(shapes)

    def run(batches):
        for batch in batches:
            ids, t, ch = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            y = centred(batch.column(3))
            energy, kind = np.einsum("bct,bct->b", y, y), of[ch]
            for k in np.unique(kind):
                own = np.flatnonzero(kind == k)
                place, choice, coef, got = _pursuit(shapes[first[k]], omega, c, places).run(y[own], c.sources, c.min_gain, c.apart)
                i, j = np.nonzero(place >= 0)
                x, pick = coef[i, j], choice[i, j]
                q, lag = (np.abs(x).argmax(1), pick) if c.shape == "free" else (pick // lags, pick % lags)
                amp = np.sqrt((x * x).sum(1)) if c.shape == "free" else x[:, 0]
                cols = [ids[own][i], t[own][i], ch[own][i], j, place[i, j], q, lag - c.most_lag, amp, got[i], energy[own][i]]
                kinds = [pa.int64(), pa.float64(), *[pa.int32()] * 5, *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(cols, kinds, strict=True)], [s.split()[0] for s in SOURCES.split(", ")])

    return spikes.select("spike_id", "t", "channel", "w").mapInArrow(run, SOURCES)
