"""One-source assignment over large candidate sets, by packed quadratic forms.

What candidate g captures of spike Y with shapes a is |a Y' g|^2 = g' P g with P = (Y a')(Y a')', symmetric in the contacts. Its upper
triangle (36 numbers for 8 contacts) holds all that matters of a spike, and a candidate is a vector of the same length with
off-diagonal products doubled, so scores are one matrix product of candidate blocks with spike blocks. Codebooks need not be
orthonormal: they are whitened first, so the score is what the best coefficients capture.

An Arrow task keeps the packed forms of up to ``HELD`` spikes, groups them by geometry, and runs through the candidates in blocks: a block's
products are built once for all spikes of a geometry, and a running maximum keeps each spike's best. Memory is bounded by a block
times a slice of spikes whatever the numbers of candidates and spikes. Equal scores (to 9 decimals) go to the smallest candidate. No shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.operators.candidates import Candidates
from tidemark.operators.inference import centred
from tidemark.sources.recording import SLOTS, geometry

HELD, BLOCK, SLICE = 32_768, 1024, 256


def triangle(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and weights (2 off the diagonal) of a packed symmetric form."""
    i, j = np.triu_indices(n)
    return i, j, np.where(i == j, 1.0, 2.0)


def whitener(omega: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Rows spanning what omega's do, orthonormal up to the ridge: |whitener Y' g|^2 is what the best coefficients of omega capture."""
    return np.linalg.solve(np.linalg.cholesky(omega @ omega.T + ridge * np.eye(len(omega))), omega)


def pack_forms(y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """(spikes, entries): the upper triangles of (Y a')(Y a')'."""
    m = y @ omega.T
    i, j, _ = triangle(y.shape[1])
    return np.matmul(m, m.transpose(0, 2, 1))[:, i, j]


def products(g: np.ndarray) -> np.ndarray:
    """Candidates' vectors that meet packed forms."""
    i, j, w = triangle(g.shape[1])
    return g[:, i] * g[:, j] * w


def best(forms: np.ndarray, candidates: Candidates, dx: np.ndarray, dy: np.ndarray, block: int = BLOCK, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """(k, score) of each form's best candidate, by a running maximum over blocks of candidates."""
    k, top = np.zeros(len(forms), np.int64), np.full(len(forms), -np.inf)
    for lo in range(0, len(candidates), block):
        phi = products(candidates.footprints(dx, dy, lo, min(lo + block, len(candidates))))
        for s in range(0, len(forms), slice_):
            own = slice(s, s + slice_)
            score = forms[own] @ phi.T
            here = score.argmax(1)
            got = score[np.arange(len(here)), here]
            # rounding keeps the order, so only where others come within it of the largest can a smaller candidate stand for it
            near = np.flatnonzero((score >= (got - 2e-9 - 1e-15 * np.abs(got))[:, None]).sum(1) > 1)
            if len(near):
                here[near] = np.round(score[near], 9).argmax(1)
                got[near] = score[near, here[near]]
            better = np.round(got, 9) > np.round(top[own], 9)
            top[own] = np.where(better, got, top[own])
            k[own] = np.where(better, here + lo, k[own])
    return k, top


def forms(spikes: DataFrame, omega: np.ndarray) -> DataFrame:
    """spike_id, channel, energy, p (array: the packed form): all that assignment needs of a spike, waveform-free."""
    turn = whitener(omega)

    def run(batches):
        for batch in batches:
            y = centred(batch.column(2))
            p = pack_forms(y, turn)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("bct,bct->b", y, y)), flat], ["spike_id", "channel", "energy", "p"])

    return spikes.select("spike_id", "channel", "w").mapInArrow(run, "spike_id long, channel int, energy double, p array<double>")


def assigned(packed: DataFrame, candidates: Candidates, keep: bool = False) -> DataFrame:
    """spike_id, channel, k, site, profile, score, energy (and p, with ``keep``) of packed spikes, each at its best candidate.

    The 64 contacts' neighbourhoods and the candidates' sites are shipped with the tasks; footprints are built there, block by block.
    """
    rows = geometry(packed.sparkSession).select("channel", "dx", "dy").collect()
    kinds: dict[tuple, int] = {}
    of = {r["channel"]: kinds.setdefault((tuple(r["dx"]), tuple(r["dy"])), len(kinds)) for r in rows}
    offsets, n, p = [tuple(np.array(v) for v in key) for key in kinds], SLOTS * (SLOTS + 1) // 2, len(candidates.profiles)
    schema = "spike_id long, channel int, k long, site long, profile int, score double, energy double" + ", p array<double>" * keep

    def run(batches):
        held: list = []

        def flush():
            ids, channel, energy = (np.concatenate([h[i] for h in held]) for i in range(3))
            f = np.concatenate([h[3] for h in held])
            kind = np.array([of[c] for c in channel.tolist()], np.int64)
            k, score = np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for g in np.unique(kind):
                own = np.flatnonzero(kind == g)
                k[own], score[own] = best(f[own], candidates, *offsets[g])
            cols = [pa.array(ids), pa.array(channel), pa.array(k), pa.array(k // p), pa.array((k % p).astype(np.int32)), pa.array(score), pa.array(energy)]
            if keep:
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * n, pa.int32()), pa.array(f.ravel())))
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            f = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), f))
            if sum(len(h[0]) for h in held) >= HELD:
                yield flush()
                held = []
        if held:
            yield flush()

    return packed.select("spike_id", "channel", "energy", "p").mapInArrow(run, schema)


def hard_coefficients(y: np.ndarray, g: np.ndarray, omega: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (spikes, shapes) of each spike at its unit footprint g (spikes, contacts), and what they capture."""
    b = np.einsum("bc,bcm->bm", g, y @ omega.T)
    v = np.linalg.solve(omega @ omega.T + ridge * np.eye(len(omega)), b.T).T
    return v, np.einsum("bm,bm->b", v, b)
