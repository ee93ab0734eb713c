"""Source inference on spikes in Arrow batches: exact one-source assignment, pair refits, greedy multi-source pursuit."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import literal, unit
from tidemark.functions.kernels import KERNELS
from tidemark.sources.recording import SAMPLES, SLOTS, geometry

#: Candidate places around a channel's anchor.
LATTICE = [(x, y, z) for x in (-20.0, 0.0, 20.0) for y in (-20.0, 0.0, 20.0) for z in (5.0, 20.0, 60.0)]
WIDTH = 15.0


def dct(m: int, t: int = SAMPLES) -> np.ndarray:
    """The first m non-constant rows of the orthonormal cosine basis."""
    k, n = np.arange(1, m + 1)[:, None], np.arange(t)[None]
    return np.sqrt(2 / t) * np.cos(math.pi * (2 * n + 1) * k / (2 * t))


def footprints(spark, kernel: str = "monopole", lattice=None, a: float = WIDTH, b: float = 2.0) -> DataFrame:
    """channel, x, y, cand: array<struct<n,px,py,pz,g>>, g the unit footprint over the slots. One row a channel."""
    k = KERNELS[kernel]
    cands = []
    for n, (px, py, pz) in enumerate(lattice or LATTICE):
        g = F.zip_with("dx", "dy", lambda dx, dy: k((dx - px) * (dx - px) + (dy - py) * (dy - py), F.lit(pz * pz), a, b))  # noqa: B023
        cands.append(F.struct(F.lit(n).alias("n"), F.lit(px).alias("px"), F.lit(py).alias("py"), F.lit(pz).alias("pz"), unit(g).alias("g")))
    return geometry(spark).select("channel", "x", "y", "cfg", F.array(*cands).alias("cand"))


def shapes_by_channel(spark, kernel: str = "monopole", lattice=None) -> np.ndarray:
    """Unit footprints (channels, slots, candidates): a fixed table of the probe, computed once and shipped with the tasks."""
    rows = sorted(footprints(spark, kernel, lattice).select("channel", "cand").collect(), key=lambda r: r["channel"])
    return np.array([[c["g"] for c in r["cand"]] for r in rows]).transpose(0, 2, 1)


def by_geometry(shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each channel and a channel of each kind: channels with the same footprints, whose spikes are searched together."""
    _, first, of = np.unique(shapes.reshape(len(shapes), -1), axis=0, return_index=True, return_inverse=True)
    return of.ravel(), first


def centred(column: pa.Array) -> np.ndarray:
    """(spikes, slots, samples) of a column of waveforms, each row less its mean."""
    y = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SLOTS, SAMPLES)
    return y - y.mean(2, keepdims=True)


def coefficients(y: np.ndarray, h: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """(spikes, candidates, shapes): what each place would take of each shape."""
    return np.matmul(h.transpose(0, 2, 1), y @ omega.T)


def assigned(spikes: DataFrame, kernel: str = "monopole", m: int = 4, k: int = 1) -> DataFrame:
    """spike_id, t, channel, amp, kind, energy, and the k best places: top: array<struct<n,score>>; ties to the smaller n.

    Scores are two matrix products over an Arrow batch; no shuffle, and nothing but the probe's footprints is shipped.
    """
    omega, shapes = dct(m), shapes_by_channel(spikes.sparkSession, kernel)
    kind = pa.list_(pa.struct([("n", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            y = centred(batch.column(5))
            u = coefficients(y, shapes[batch.column(2).to_numpy()], omega)
            score = np.einsum("bnm,bnm->bn", u, u)
            # ordered by rounded scores: places of equal score are ties whatever the order of their sums
            best = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]
            flat = pa.StructArray.from_arrays([pa.array(best.ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], ["n", "score"])
            top = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * best.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.einsum("bct,bct->b", y, y)), top.cast(kind)], ["spike_id", "t", "channel", "amp", "kind", "energy", "top"])

    return spikes.select("spike_id", "t", "channel", "amp", "kind", "w").mapInArrow(run, "spike_id long, t double, channel int, amp double, kind string, energy double, top array<struct<n:long,score:double>>")


def located(spikes: DataFrame, kernel: str = "monopole") -> DataFrame:
    """spike_id, t, channel, amp, kind, n, px, py, pz (um, absolute), score, energy."""
    a = assigned(spikes, kernel).withColumn("best", F.element_at("top", 1)).join(F.broadcast(geometry(spikes.sparkSession).select("channel", "x", "y")), "channel")
    place = [F.element_at(literal([c[i] for c in LATTICE]), (F.col("best.n") + 1).cast("int")) for i in range(3)]
    return a.select("spike_id", "t", "channel", "amp", "kind", F.col("best.n").alias("n"), (F.col("x") + place[0]).alias("px"), (F.col("y") + place[1]).alias("py"), place[2].alias("pz"), F.col("best.score").alias("score"), "energy")


_TERMS = "spike_id long, n1 long, n2 long, s1 double, s2 double, c double, captured double, condition double"


def _pairs(spikes: DataFrame, kernel: str, m: int, every: bool) -> DataFrame:
    """Joint refit with free shapes of two places: the 2 x 2 system in closed form.

    captured = (|u1|^2 + |u2|^2 - 2 c u1.u2) / (1 - c^2) with u_i the coefficients under place i and c the footprints' overlap;
    leaving one place out loses captured - |u of the other|^2.
    """
    omega, shapes = dct(m), shapes_by_channel(spikes.sparkSession, kernel)
    overlap = np.matmul(shapes.transpose(0, 2, 1), shapes)
    left, right = np.triu_indices(shapes.shape[2], 1)

    def run(batches):
        for batch in batches:
            channel = batch.column(1).to_numpy()
            u = coefficients(centred(batch.column(2)), shapes[channel], omega)
            s, here = np.einsum("bnm,bnm->bn", u, u), np.arange(len(u))
            if every:
                c, x = overlap[channel][:, left, right], np.matmul(u, u.transpose(0, 2, 1))[:, left, right]
                apart = 1 - c * c
                got = np.where(apart > 1e-9, (s[:, left] + s[:, right] - 2 * c * x) / np.maximum(apart, 1e-9), np.maximum(s[:, left], s[:, right]))
                best = np.round(got, 9).argmax(1)  # ties to the smaller places
                one, two, got = left[best], right[best], got[here, best]
                swap = s[here, one] < s[here, two]
                one, two = np.where(swap, two, one), np.where(swap, one, two)
            else:
                order = np.argsort(-np.round(s, 9), axis=1, kind="stable")
                one, two = order[:, 0], order[:, 1]
            c = overlap[channel, one, two]
            if not every:
                got = (s[here, one] + s[here, two] - 2 * c * np.einsum("bm,bm->b", u[here, one], u[here, two])) / np.maximum(1 - c * c, 1e-12)
            condition = (1 + np.abs(c)) / np.maximum(1 - np.abs(c), 1e-12)
            cols = [one, two, s[here, one], s[here, two], c, got, condition]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in cols)], [x.split()[0] for x in _TERMS.split(", ")])

    return spikes.select("spike_id", "channel", "w").mapInArrow(run, _TERMS)


def pair_terms(spikes: DataFrame, kernel: str = "monopole", m: int = 4) -> DataFrame:
    """Joint refit of each spike's two best single places (ties to the smaller n)."""
    return _pairs(spikes, kernel, m, False)


def pair_search(spikes: DataFrame, kernel: str = "monopole", m: int = 4) -> DataFrame:
    """Best joint refit of each spike over all pairs of places; n1 is the better single. Footprints that coincide capture what
    the better one does."""
    return _pairs(spikes, kernel, m, True)


def shift_bank(omega: np.ndarray, most: int) -> np.ndarray:
    """Rows q * (2 * most + 1) + lag + most: each codebook row shifted without wrapping, unit norm."""
    out = []
    for w in omega:
        for lag in range(-most, most + 1):
            v = np.zeros_like(w)
            if lag >= 0:
                v[lag:] = w[: len(w) - lag]
            else:
                v[:lag] = w[-lag:]
            out.append(v / max(np.linalg.norm(v), 1e-8))
    return np.array(out)


def supports(r: int) -> list[list[int]]:
    """All non-empty subsets of r sources, smallest first."""
    return [[j for j in range(r) if mask >> j & 1] for mask in sorted(range(1, 1 << r), key=lambda x: (bin(x).count("1"), x))]


def refit_nonnegative(gram: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact non-negative least squares of many systems of a few sources, and what each captures.

    The optimum is the least-squares solution on some support where that solution is positive; there are 2**r - 1 supports, and of
    those that qualify the one that captures most is it. Sources off the support get 0. Beyond four sources supports are found by
    pivoting instead.
    """
    b, r = rhs.shape
    if r > 4:
        return pivoted_nonnegative(gram, rhs)
    best, most = np.zeros_like(rhs), np.zeros(b)
    for on in supports(r):
        g = gram[:, on][:, :, on] + 1e-9 * np.eye(len(on))
        x = np.linalg.solve(g, rhs[:, on, None])[..., 0]
        got = np.einsum("bj,bj->b", x, rhs[:, on])
        better = (x > 0).all(1) & (got > most)
        most = np.where(better, got, most)
        full = np.zeros_like(rhs)
        full[:, on] = x
        best = np.where(better[:, None], full, best)
    return best, most


def pivoted_nonnegative(gram: np.ndarray, rhs: np.ndarray, patience: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares of many systems by principal pivoting: all entries of the wrong sign change sides, and only the
    last of them once that hasn't lowered their number `patience` times. A positive definite Gram matrix makes it end."""
    b, r = rhs.shape
    g = gram + 1e-9 * np.eye(r)
    on, x = np.ones((b, r), bool), np.zeros((b, r))
    fewest, tries, going = np.full(b, r + 1), np.full(b, patience), np.arange(b)
    for _ in range(64 * r):
        m = on[going]
        both = m[:, :, None] & m[:, None]
        x[going] = np.linalg.solve(np.where(both, g[going], 0) + ~m[:, :, None] * np.eye(r), np.where(m, rhs[going], 0)[..., None])[..., 0]
        slack = np.einsum("bij,bj->bi", g[going], x[going]) - rhs[going]
        wrong = np.where(m, x[going] < -1e-12, slack < -1e-12)
        many = wrong.sum(1)
        if not many.any():
            break
        fewer = many < fewest[going]
        tries[going] = np.where(fewer, patience, tries[going] - 1)
        fewest[going] = np.where(fewer, many, fewest[going])
        last = np.arange(r)[None] == (r - 1 - wrong[:, ::-1].argmax(1))[:, None]
        on[going] ^= np.where((fewer | (tries[going] >= 0))[:, None], wrong, wrong & last)
        going = going[many > 0]
    x = np.maximum(np.where(on, x, 0), 0)
    return x, np.einsum("bj,bj->b", x, 2 * rhs - np.einsum("bij,bj->bi", gram, x))


class Pursuit:
    """Greedy search for a few sources of a batch of spikes of one geometry.

    h (C, N): unit footprints; bank (K, T): unit shapes at their lags, `lags` to a shape; places (N, 3). An atom is a place and a row
    of the bank. Sources are one atom each, with a non-negative coefficient or one of either sign (``signed``), or a place and a lag with
    free coefficients of all shapes (``free``). The residual's correlations are kept, and lose each source's part as it changes.
    """

    def __init__(self, h: np.ndarray, places: np.ndarray, bank: np.ndarray, lags: int, free: bool = False, shortlist: int = 0, signed: bool = False) -> None:
        self.h, self.bank, self.lags, self.free, self.shortlist, self.signed = h, bank, lags, free, shortlist, signed
        self.over, self.time = h.T @ h, bank @ bank.T
        self.near = np.sqrt(((places[:, None] - places[None]) ** 2).sum(2))

    def scores(self, resid: np.ndarray) -> np.ndarray:
        """(B, N, choices): how much one source could capture of the residual, before any other changes."""
        if not self.free:
            return resid**2 if self.signed else np.maximum(resid, 0) ** 2
        by_lag = resid.reshape(*resid.shape[:2], -1, self.lags)
        return np.einsum("bnql,bnql->bnl", by_lag, by_lag)

    def rows(self, choice: np.ndarray) -> np.ndarray:
        """Rows of the bank that each choice stands for: (B, rows of a source)."""
        if not self.free:
            return choice[:, None]
        return np.arange(len(self.bank) // self.lags)[None] * self.lags + choice[:, None]

    def run(self, y: np.ndarray, sources: int, min_gain: float, apart: float, ridge: float = 1e-6):
        """places, choices (B, sources; -1: none), coefficients (B, sources, rows of a source), captured (B,)."""
        corr = np.matmul(np.matmul(self.h.T, y), self.bank.T)
        b, n_places, _ = corr.shape
        width = len(self.bank) // self.lags if self.free else 1
        here, resid = np.arange(b), corr.copy()
        closed = np.zeros((b, n_places), dtype=bool)
        if self.shortlist and self.shortlist < n_places:
            # screening by what a place captures at no lag
            still = corr[:, :, self.lags // 2 :: self.lags]
            rank = np.argsort(-np.einsum("bnq,bnq->bn", still, still), axis=1, kind="stable")
            closed[here[:, None], rank[:, self.shortlist :]] = True
        place, choice = np.full((b, sources), -1), np.full((b, sources), -1)
        coef, captured, going = np.zeros((b, sources, width)), np.zeros(b), np.arange(b)
        for r in range(sources):
            if not len(going):
                break
            s = self.scores(resid[going])
            s[closed[going]] = -1
            flat = s.reshape(len(going), -1)
            pick = flat.argmax(1)
            found = flat[np.arange(len(going)), pick] > 0
            # the first source stands even if nothing is captured
            going, pick = (going, pick) if r == 0 else (going[found], pick[found])
            if not len(going):
                break
            place[going, r], choice[going, r] = pick // s.shape[2], pick % s.shape[2]
            p = place[going, : r + 1]
            atoms = np.stack([self.rows(choice[going, j]) for j in range(r + 1)], 1).reshape(len(going), -1)
            owner = np.repeat(p, width, axis=1)
            gram = self.over[owner[:, :, None], owner[:, None]] * self.time[atoms[:, :, None], atoms[:, None]]
            rhs = corr[going[:, None], owner, atoms]
            if self.free or self.signed:
                x = np.linalg.solve(gram + ridge * np.eye(gram.shape[1]), rhs[..., None])[..., 0]
                got = 2 * np.einsum("bj,bj->b", x, rhs) - np.einsum("bj,bjk,bk->b", x, gram, x)
            else:
                x, got = refit_nonnegative(gram, rhs)
            gain = np.ones(len(going), dtype=bool) if r == 0 else got - captured[going] > min_gain
            stopped, going = going[~gain], going[gain]
            place[stopped, r], choice[stopped, r] = -1, -1
            x, new = x[gain].reshape(len(going), r + 1, width), got[gain]
            # the correlations change by what each source's coefficients change
            change = x - coef[going, : r + 1]
            for j in range(r + 1):
                rows = self.rows(choice[going, j])
                resid[going] -= self.over[place[going, j]][:, :, None] * np.einsum("bw,bwk->bk", change[:, j], self.time[rows])[:, None]
            coef[going, : r + 1], captured[going] = x, new
            closed[going] |= self.near[place[going, r]] < apart
        return place, choice, coef, captured


SOURCES = "spike_id long, t double, channel int, rank int, n int, q int, lag int, amp double, captured double, energy double"


def sources(spikes: DataFrame, r: int = 3, m: int = 4, most_lag: int = 1, min_gain: float = 0.05, apart: float = 4.0, kernel: str = "monopole", shortlist: int = 0, free: bool = False) -> DataFrame:
    """One row for each source of each spike (see Pursuit); with free shapes q is the strongest, amp the norm of all coefficients.
    Stateless by batch, so it also runs on a stream."""
    shape = shapes_by_channel(spikes.sparkSession, kernel)
    bank, places, lags = shift_bank(dct(m), most_lag), np.array(LATTICE), 2 * most_lag + 1
    of, first = by_geometry(shape)

    def run(batches):
        for batch in batches:
            ids, t, ch = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            y = centred(batch.column(3))
            energy, kind = np.einsum("bct,bct->b", y, y), of[ch]
            for c in np.unique(kind):
                own = np.flatnonzero(kind == c)
                place, choice, coef, got = Pursuit(shape[first[c]], places, bank, lags, free, shortlist).run(y[own], r, min_gain, apart)
                i, j = np.nonzero(place >= 0)
                x, k = coef[i, j], choice[i, j]
                q, lag = (np.abs(x).argmax(1), k) if free else (k // lags, k % lags)
                amp = np.sqrt((x * x).sum(1)) if free else x[:, 0]
                cols = [ids[own][i], t[own][i], ch[own][i], j, place[i, j], q, lag - most_lag, amp, got[i], energy[own][i]]
                kinds = [pa.int64(), pa.float64(), *[pa.int32()] * 5, *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(cols, kinds, strict=True)], [s.split()[0] for s in SOURCES.split(", ")])

    return spikes.select("spike_id", "t", "channel", "w").mapInArrow(run, SOURCES)
