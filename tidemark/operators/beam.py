"""Sources of a spike by beam search over supports, with exact refits.

Kept for each spike are the best few partial supports. For a support S, r_n = h_n' (what S leaves of the spike) and
d_n = the part of |h_n|^2 that S doesn't span, for all places n at once; adding n captures exactly |r_n|^2 / d_n more, so one pass
scores a support's extensions over all places without solving a system. r and d lose the new direction's part when a place joins.
Supports that hold the same places in another order are one. Valid extensions keep a least distance between places and a largest condition
of the Gram matrix.

Two families: free shapes (each source has its own coefficients) and one shared shape (sources differ by weights of sum 1, refitted
exactly: the best of all faces of the simplex). A level's best support is taken if it gains more than ``min_gain`` over what was taken
before and its weakest source holds ``least_share`` of the amplitude; else the search ends for the spike. Spikes whose whole
energy in the shapes can't gain that much over their best single source aren't searched; they are single exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.operators import solvers
from tidemark.operators.inference import LATTICE, by_geometry, centred, dct, shapes_by_channel


@dataclass(frozen=True)
class Model:
    shared: bool
    sources: int
    equal: bool = False  # both weights are 1/2
    forced: bool = False  # a second source is taken whatever it gains
    least: float = 0.0  # least weight of either of two sources


#: The models by name.
MODELS = {
    "m0": Model(False, 1),
    "m1_eq2": Model(True, 2, equal=True, forced=True),
    "m1_w2": Model(True, 2),
    "m1_x2": Model(True, 2, forced=True, least=0.1),
    "m1_r3": Model(True, 3),
    "m1_r4": Model(True, 4),
    "m2_r2": Model(False, 2),
    "m2_r3": Model(False, 3),
    "m2_r4": Model(False, 4),
}
MOST = 4_000_000  # entries of the residual correlations held at once


@dataclass(frozen=True)
class Options:
    beam: int = 8
    shortlist: int = 16  # extensions beyond two sources of a shared shape
    all_seconds: bool = True  # every place is a candidate to extend free supports and pairs; else only the shortlist
    apart: float = 4.0
    most_condition: float = 1e4
    least_share: float = 0.02
    min_gain: float = 0.0


def gram_condition(over: np.ndarray, support: np.ndarray) -> np.ndarray:
    """Largest over smallest eigenvalue of the Gram matrix of each support (..., k)."""
    if support.shape[-1] == 2:
        c = np.abs(over[support[..., 0], support[..., 1]])
        return (1 + c) / np.maximum(1 - c, 1e-10)
    e = np.linalg.eigvalsh(over[support[..., :, None], support[..., None, :]])
    return e[..., -1] / np.maximum(e[..., 0], 1e-10)


def selected(score: np.ndarray, supports: np.ndarray, over: np.ndarray, beam: int, most: float) -> np.ndarray:
    """(B, beam) columns of the best valid supports (B, X, k sorted), no set twice; -1 where there are fewer."""
    b, x, k = supports.shape
    key = (supports * (over.shape[0] ** np.arange(k - 1, -1, -1, dtype=np.int64))).sum(2)
    order = np.lexsort((key, -np.round(score, 9)), axis=-1)
    out, taken = np.full((b, beam), -1), np.zeros(b, np.int64)
    seen = np.full((b, beam), -1, np.int64)
    wide = max(1, beam * k)
    for s in range(0, x, wide):
        going = np.flatnonzero(taken < beam)
        if not len(going):
            break
        cut = order[going, s : s + wide]
        rows = going[:, None]
        fine = np.isfinite(score[rows, cut])
        if not fine.any():
            break
        fine &= gram_condition(over, supports[rows, cut]) <= most
        for c in range(cut.shape[1]):
            own = key[going, cut[:, c]]
            ok = fine[:, c] & (taken[going] < beam) & (seen[going] != own[:, None]).all(1)
            at = going[ok]
            out[at, taken[at]], seen[at, taken[at]] = cut[ok, c], own[ok]
            taken[at] += 1
    return out


class Beam:
    """Search for the spikes of one geometry: footprints' overlaps (N, N), places (N, 3)."""

    def __init__(self, over: np.ndarray, places: np.ndarray, model: Model, options: Options) -> None:
        self.over, self.model, self.o = over, model, options
        self.near = np.sqrt(((places[:, None] - places[None]) ** 2).sum(2))

    def valid(self, supports: np.ndarray) -> np.ndarray:
        """(B, L, N): whether n is another place than all of a support, and far enough from them."""
        far = self.near[supports].min(2) >= self.o.apart
        np.put_along_axis(far, supports, False, 2)
        return far

    def run(self, u: np.ndarray, energy: np.ndarray):
        """u (B, N, M): places' coefficients; energy (B,): what all shapes hold of the spike.

        places (B, R; -1: none), coefficients (B, R, M), captured, condition, gain of the second source, searched."""
        b, n, m = u.shape
        r = self.model.sources
        place, coef = np.full((b, r), -1), np.zeros((b, r, m))
        s = np.einsum("bnm,bnm->bn", u, u)
        first = np.argsort(-np.round(s, 9), axis=1, kind="stable")
        here = np.arange(b)
        place[:, 0], coef[:, 0] = first[:, 0], u[here, first[:, 0]]
        captured, condition, gain = s[here, first[:, 0]].copy(), np.ones(b), np.zeros(b)
        slack = 1e-9 * np.maximum(1, energy)
        searched = np.full(b, self.model.forced) | (energy - captured + slack > self.o.min_gain)
        searched &= r > 1
        rows = np.flatnonzero(searched)
        size = max(1, MOST // max(1, min(self.o.beam, n) * n * m))
        for at in range(0, len(rows), size):
            own = rows[at : at + size]
            found = (self._shared if self.model.shared else self._free)(u[own], s[own], first[own])
            alive = np.ones(len(own), bool)
            for k, (support, x, got, cond) in enumerate(found, 2):
                more = got - captured[own]
                amp = np.sqrt((x * x).sum(2))
                weak = amp.min(1) / np.maximum(amp.sum(1), 1e-12)
                if k == 2:
                    gain[own] = np.where(np.isfinite(more), more, 0)
                accept = alive & np.isfinite(got)
                if not self.model.forced:
                    accept &= (more > self.o.min_gain) & (weak >= self.o.least_share)
                hit = own[accept]
                place[hit, :k], coef[hit, :k] = support[accept], x[accept]
                captured[hit], condition[hit] = got[accept], cond[accept]
                alive = accept
        return place, coef, captured, condition, gain, searched

    def _level(self, supports, score, choices):
        """The best supports that extend `supports` (B, L, k) by `choices` (B, L, X): their parents, new places, sets and scores."""
        b, count, x = choices.shape
        wide = np.concatenate([np.broadcast_to(supports[:, :, None], (b, count, x, supports.shape[2])), choices[..., None]], 3)
        sets = np.sort(wide.reshape(b, count * x, -1), axis=2)
        pick = selected(score.reshape(b, -1), sets, self.over, self.o.beam, self.o.most_condition)
        safe, rows = np.maximum(pick, 0), np.arange(b)[:, None]
        got = np.where(pick >= 0, score.reshape(b, -1)[rows, safe], -np.inf)
        return safe // x, choices.reshape(b, -1)[rows, safe], np.take_along_axis(sets, safe[..., None], 1), got

    def _free(self, u, s, first):
        b, n, m = u.shape
        rows = np.arange(b)[:, None]
        supports = first[:, : self.o.beam, None]
        own = supports[:, :, 0]
        captured, q = s[rows, own], self.over[own][:, :, None]
        resid = u[:, None] - self.over[own][..., None] * u[rows, own][:, :, None]
        left = 1 - self.over[own] ** 2
        allowed = np.zeros((b, n), bool)
        if self.o.all_seconds:
            allowed[:] = True
        else:
            np.put_along_axis(allowed, first[:, : self.o.shortlist], True, 1)
        every = np.arange(n)
        for k in range(2, self.model.sources + 1):
            ok = self.valid(supports) & (left > 1e-9) & allowed[:, None] & np.isfinite(captured)[..., None]
            more = np.einsum("blnm,blnm->bln", resid, resid) / np.maximum(left, 1e-9)
            score = np.where(ok, captured[..., None] + more, -np.inf)
            parent, new, sets, got = self._level(supports, score, np.broadcast_to(every, score.shape))
            # the new direction leaves the residual of every place
            o = self.over[new] - np.einsum("blj,bljn->bln", q[rows[..., None], parent[..., None], np.arange(k - 1), new[..., None]], q[rows, parent])
            d = np.maximum(left[rows, parent, new], 1e-9)
            resid = resid[rows, parent] - (o / d[..., None])[..., None] * resid[rows, parent, new][:, :, None]
            left = left[rows, parent] - o * o / d[..., None]
            q = np.concatenate([q[rows, parent], (o / np.sqrt(d)[..., None])[:, :, None]], 2)
            supports, captured = sets, got
            top = sets[:, 0]
            gram, rhs = self.over[top[:, :, None], top[:, None]], u[np.arange(b)[:, None], top]
            x = np.linalg.solve(gram + 1e-12 * np.eye(k), rhs)
            yield top, x, got[:, 0], gram_condition(self.over, top)

    def _shared(self, u, s, first):
        b, n, m = u.shape
        rows = np.arange(b)[:, None]
        supports = first[:, : self.o.beam, None]
        own = supports[:, :, 0]
        every = np.arange(n)[None, None]
        choices = np.broadcast_to(every if self.o.all_seconds else first[:, None, : self.o.shortlist], (b, own.shape[1], n if self.o.all_seconds else min(n, self.o.shortlist)))
        for k in range(2, self.model.sources + 1):
            ok = np.take_along_axis(self.valid(supports), choices, 2)
            wide = np.concatenate([np.broadcast_to(supports[:, :, None], (*choices.shape, k - 1)), choices[..., None]], 3)
            flat = wide.reshape(-1, k)
            spike = np.repeat(np.arange(b), flat.shape[0] // b)
            if k > 2:
                # a set is scored once a spike, however many supports lead to it
                asked = np.flatnonzero(ok.ravel())
                flat, spike = np.sort(flat[asked], axis=1), spike[asked]
                key = spike.astype(np.int64)
                for j in range(k):
                    key = key * n + flat[:, j]
                _, one, back = np.unique(key, return_index=True, return_inverse=True)
                got = np.full(ok.size, -np.inf)
                got[asked] = solvers.shared_sets(u, self.over, spike[one], flat[one])[1][back]
            else:
                uk, gram = u[spike[:, None], flat], self.over[flat[:, :, None], flat[:, None]]
                if self.model.equal:
                    v = uk.sum(1) / 2
                    got = np.einsum("bm,bm->b", v, v) / np.maximum((1 + gram[:, 0, 1]) / 2, 1e-10)
                else:
                    got = solvers.shared_pair(uk[:, 0], uk[:, 1], gram[:, 0, 1], self.model.least)[1]
            score = np.where(ok, got.reshape(choices.shape), -np.inf)
            parent, new, sets, got = self._level(supports, score, choices)
            # beyond pairs supports grow over the shortlist
            supports = sets
            choices = np.broadcast_to(first[:, None, : self.o.shortlist], (b, sets.shape[1], min(n, self.o.shortlist)))
            top = sets[:, 0]
            gram, rhs = self.over[top[:, :, None], top[:, None]], u[np.arange(b)[:, None], top]
            if self.model.equal:
                w = np.full((b, 2), 0.5)
            elif k == 2:
                one = solvers.shared_pair(rhs[:, 0], rhs[:, 1], gram[:, 0, 1], self.model.least)[0]
                w = np.stack([one, 1 - one], 1)
            else:
                w = solvers.shared_sets(u, self.over, np.arange(b), top)[0]
            v = np.einsum("bk,bkm->bm", w, rhs) / np.maximum(np.einsum("bk,bkj,bj->b", w, gram, w), 1e-12)[:, None]
            yield top, w[..., None] * v[:, None], got[:, 0], gram_condition(self.over, top)


def losses(over: np.ndarray, u: np.ndarray, place: np.ndarray, coef: np.ndarray, shared: bool) -> tuple[np.ndarray, np.ndarray]:
    """(B, R) what the error rises by without each source: with the others as they are, and with them fitted again."""
    on, safe = place >= 0, np.maximum(place, 0)
    gram = over[safe[:, :, None], safe[:, None]] * (on[:, :, None] & on[:, None])
    rhs = np.take_along_axis(u, safe[..., None], 1) * on[..., None]
    left = rhs - np.matmul(gram, coef)
    still = np.where(on, np.einsum("brm,brm->br", coef, coef) + 2 * np.einsum("brm,brm->br", coef, left), 0)
    again = np.zeros_like(still)
    for r in range(place.shape[1]):
        others = [j for j in range(place.shape[1]) if j != r]
        rows = np.flatnonzero(on[:, r])
        if not len(rows):
            continue
        if not others or not on[rows][:, others].any():
            again[rows, r] = np.einsum("bm,bm->b", rhs[rows, r], rhs[rows, r])
            continue
        g, b = gram[rows][:, others][:, :, others], rhs[rows][:, others]
        off = ~on[rows][:, others]
        g = g + off[:, :, None] * np.eye(len(others))
        x = coef[rows]
        now = 2 * np.einsum("brm,brm->b", x, rhs[rows]) - np.einsum("brm,brs,bsm->b", x, gram[rows], x)
        if shared:
            rest = solvers.shared_best(np.matmul(b, b.transpose(0, 2, 1)), g)[1]
        else:
            rest = np.einsum("brm,brm->b", np.linalg.solve(g + 1e-12 * np.eye(len(others)), b), b)
        again[rows, r] = now - rest
    return still, again


SCHEMA = "spike_id long, t double, channel int, rank int, n int, amp double, share double, leaveout double, refit_loss double, coef array<double>, support int, captured double, energy double, condition double, gain double, searched boolean"


def sources(spikes: DataFrame, model: str = "m2_r2", m: int = 4, kernel: str = "monopole", lattice=None, options: Options = Options()) -> DataFrame:
    """One row a source, strongest first (rank from 0; equal amplitudes by place). An unknown model is a ValueError. One narrow stage."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}: one of {sorted(MODELS)}")
    kind, places = MODELS[model], np.array(lattice or LATTICE)
    omega, shapes = dct(m), shapes_by_channel(spikes.sparkSession, kernel, lattice)
    of, first = by_geometry(shapes)

    def run(batches):
        for batch in batches:
            ids, t, channel = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            y = centred(batch.column(3))
            z = y @ omega.T
            energy, inside = np.einsum("bct,bct->b", y, y), np.einsum("bcm,bcm->b", z, z)
            geometry = of[channel]
            for c in np.unique(geometry):
                own = np.flatnonzero(geometry == c)
                h = shapes[first[c]]
                over, u = h.T @ h, np.matmul(h.T, z[own])
                place, coef, captured, condition, gain, searched = Beam(over, places, kind, options).run(u, inside[own])
                still, again = losses(over, u, place, coef, kind.shared)
                amp = np.where(place >= 0, np.sqrt((coef * coef).sum(2)), -1.0)
                order = np.lexsort((place, -np.round(amp, 9)), axis=1)
                place, amp, still, again = (np.take_along_axis(v, order, 1) for v in (place, amp, still, again))
                coef = np.take_along_axis(coef, order[..., None], 1)
                share = amp / np.maximum(np.maximum(amp, 0).sum(1, keepdims=True), 1e-12)
                i, j = np.nonzero(place >= 0)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * m, pa.int32()), pa.array(coef[i, j].ravel()))
                cols = [ids[own][i], t[own][i], channel[own][i], j, place[i, j], amp[i, j], share[i, j], still[i, j], again[i, j], flat, (place >= 0).sum(1)[i], captured[i], energy[own][i], condition[i], gain[i], searched[i]]
                kinds = [pa.int64(), pa.float64(), *[pa.int32()] * 3, *[pa.float64()] * 4, None, pa.int32(), *[pa.float64()] * 4, pa.bool_()]
                yield pa.RecordBatch.from_arrays([v if k is None else pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return spikes.select("spike_id", "t", "channel", "w").mapInArrow(run, SCHEMA)
