"""Soft mixtures: a spike as a non-negative combination of all places and shapes, and the fit of their places, widths and shapes.

With footprints G (contacts x places) and shapes A of unit length, a spike is about G X A with X >= 0 of its own (places x shapes). The
normal equations are a Kronecker product S (x) R, S = G'G and R = AA'; its action is S X R. X is found by active sets: few entries are
positive, and a spike takes a small solve for each that joins, gathered from a table of the product by geometry. Footprints are taken at
unit length there: a fit draws some places so near the contacts, and leaves others so far, that their strengths differ by orders of
magnitude. Spikes that this leaves short of the optimality conditions go on by accelerated projected steps with restarts, of the exact
largest curvature, until they hold. An entropy term can then draw the weight of places together, by monotone steps from that solution.

The fit goes on until it has converged. One job solves all spikes at fixed parameters and returns sums: error, the shapes' normal equations,
and the error's slopes in places and widths (chain rule by contact, kernels by a complex step). Shapes follow in closed form; places and
widths take a quasi-Newton step with them, which is shortened as long as the error rises.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import evaluate
from tidemark.operators.inference import centred
from tidemark.operators.refine import LEAST_WIDTH, inverse_softplus, softplus
from tidemark.sources.recording import geometry


def curved(x: np.ndarray, space: np.ndarray, time: np.ndarray) -> np.ndarray:
    """S X R for a batch (B, P, Q); S is one matrix or one for each."""
    return np.matmul(np.matmul(space, x), time)


def optimality(x: np.ndarray, space: np.ndarray, time: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """(B,) how far X >= 0 is from the conditions of a minimum: slopes not negative, and 0 where X is positive; 0 at the minimum."""
    slope = curved(x, space, time) - rhs
    return np.maximum(np.maximum(-slope, 0).max((1, 2)), np.minimum(x, np.abs(slope)).max((1, 2)))


def active_mixture(space: np.ndarray, time: np.ndarray, rhs: np.ndarray, tol: float, kind: np.ndarray | None = None, pivots: int = 60, widest: int = 24) -> np.ndarray:
    """X >= 0 by active sets, for spikes that need at most `pivots` solves of at most `widest` positive entries; where that isn't enough, or
    rounding stands in the way, the X that it had come to.

    The entry of steepest slope joins the positive ones, which are solved for; if that would make some negative, the step ends at the
    first to reach 0, which leaves.
    """
    b, p, q = rhs.shape
    flat, n = rhs.reshape(b, -1), p * q
    x, on = np.zeros((b, n)), np.zeros((b, n), bool)
    least = tol * np.maximum(np.abs(flat).max(1), 1e-12)
    space, kind = space.reshape(-1, p, p), np.zeros(b, np.int64) if kind is None else kind
    # one more row and column, of zeros, stand for places of a solve that a spike doesn't need
    dense = np.zeros((len(space), n + 1, n + 1))
    dense[:, :n, :n] = (space[:, :, None, :, None] * time[:, None]).reshape(-1, n, n)
    diagonal = np.concatenate([dense.diagonal(0, 1, 2)[:, :n] * (1 + 1e-13), np.ones((len(space), 1))], 1)
    going, settled = np.arange(b), np.ones(b, bool)
    for _ in range(pivots):
        # those at the optimum of their positive entries take another, or are done
        slope = (curved(x[going].reshape(-1, p, q), space[kind[going]], time) - rhs[going]).reshape(-1, n)
        slope[on[going]] = 0
        pick = slope.argmin(1)
        more = ~settled[going] | (slope[np.arange(len(going)), pick] < -least[going])
        going, pick = going[more], pick[more]
        fresh = settled[going]
        on[going[fresh], pick[fresh]] = True
        size = on[going].sum(1)
        going = going[size <= widest]
        if not len(going):
            break
        own = on[going]
        k = own.sum(1).max()
        at = np.argsort(~own, axis=1, kind="stable")[:, :k]
        real = np.take_along_axis(own, at, 1)
        held = np.where(real, at, n)
        first = (kind[going, None] * (n + 1) + held) * (n + 1)
        gram = dense.ravel().take(first[:, :, None] + held[:, None])
        gram[:, np.arange(k), np.arange(k)] = diagonal[kind[going, None], held]
        z = np.linalg.solve(gram, np.where(real, flat[going[:, None], at], 0)[..., None])[..., 0]
        now = np.take_along_axis(x[going], at, 1)
        below = real & (z <= 0)
        settled[going] = ~below.any(1)
        reach = np.where(below, now / np.maximum(now - z, 1e-300), np.inf)
        share = np.minimum(reach.min(1), 1)[:, None]
        new = np.where(real, now + share * (z - now), 0)
        gone = below & (reach <= share)
        new[gone] = 0
        full = np.zeros((len(going), n))
        np.put_along_axis(full, at, np.maximum(new, 0), 1)
        x[going] = full
        left = np.zeros((len(going), n), bool)
        np.put_along_axis(left, at, real & ~gone, 1)
        on[going] = left
    return x.reshape(b, p, q)


def grid_mixture(space: np.ndarray, time: np.ndarray, rhs: np.ndarray, l1: float = 0.0, rounds: int = 3000, tol: float = 1e-9, kind: np.ndarray | None = None) -> np.ndarray:
    """X >= 0 that minimises <X, S X R> / 2 - <X, rhs> + l1 sum(X); space is shared by the batch (P, P), or each takes that of its kind (K, P, P)."""
    space, kind = space.reshape(-1, *space.shape[-2:]), np.zeros(len(rhs), np.int64) if kind is None else kind
    size = np.sqrt(space.diagonal(0, 1, 2))
    size = np.where(size > 0, size, 1)[:, :, None]
    space, rhs, size = space / (size * size.transpose(0, 2, 1)), (rhs - l1) / size[kind], size[kind]
    length = (1 / np.maximum(np.linalg.eigvalsh(space)[:, -1] * np.linalg.eigvalsh(time)[-1], 1e-12))[kind, None, None]
    x = active_mixture(space, time, rhs, tol, kind)
    scale = np.maximum(np.abs(rhs).max((1, 2)), 1e-12)
    going = np.flatnonzero(optimality(x, space[kind], time, rhs) > tol * scale)
    xs, ys, ks = x[going], x[going], np.ones(len(going))
    for r in range(rounds if len(going) else 0):
        new = np.maximum(ys - length[going] * (curved(ys, space[kind[going]], time) - rhs[going]), 0)
        ks = np.where(((ys - new) * (new - xs)).sum((1, 2)) > 0, 1.0, ks)
        after = (1 + np.sqrt(1 + 4 * ks * ks)) / 2
        xs, ys, ks = new, new + ((ks - 1) / after)[:, None, None] * (new - xs), after
        if r % 20 == 19:
            x[going] = xs
            left = optimality(xs, space[kind[going]], time, rhs[going]) > tol * scale[going]
            going, xs, ys, ks = going[left], xs[left], ys[left], ks[left]
            if not len(going):
                break
    x[going] = xs
    return x / size


def entropy(x: np.ndarray) -> np.ndarray:
    """Of the places' shares of each X; 0 for an empty one."""
    w = x.sum(2)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    return -(w * np.log(np.where(w > 0, w, 1))).sum(1)


def _cost(x, space, time, rhs, beta):
    return (x * (curved(x, space, time) / 2 - rhs)).sum((1, 2)) + beta * entropy(x)


def entropic_mixture(space: np.ndarray, time: np.ndarray, rhs: np.ndarray, beta: float, rounds: int = 200) -> np.ndarray:
    """grid_mixture, moved on to lower its cost plus beta times the places' entropy. Steps that don't lower it are halved, so the cost never
    rises; the term isn't convex, so the start matters. A spike that a step leaves exactly where it was stays there in all shorter ones, and
    goes on no longer."""
    # shapes first: the action is then two plain products for the whole batch, and each is taken once a round
    x = np.ascontiguousarray(grid_mixture(space, time, rhs).transpose(2, 0, 1))
    rhs = np.ascontiguousarray(rhs.transpose(2, 0, 1))
    q, b, p = x.shape
    step = np.full(b, 1 / max(np.linalg.eigvalsh(space)[-1] * np.linalg.eigvalsh(time)[-1], 1e-12))

    def seen(x):
        """Action, weights of the places, their sum, entropy and cost."""
        bent = (time @ (x.reshape(-1, p) @ space).reshape(q, -1)).reshape(x.shape)
        w = x.sum(0)
        total = w.sum(1)
        share = w / np.maximum(total, 1e-300)[:, None]
        spread = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
        return bent, w, total, spread, np.einsum("qbp,qbp->b", x, bent / 2 - rhs) + beta * spread

    bent, w, total, spread, now = seen(x)
    done, going = np.empty_like(x), np.arange(b)
    for r in range(rounds):
        floor = np.maximum(total, 1e-12)
        # the entropy's slope in a place's weight, the same for all of its shapes
        pull = -(np.log(np.maximum(w / floor[:, None], 1e-12)) + spread[:, None]) / floor[:, None]
        new = np.maximum(x - step[:, None] * (bent - rhs + beta * pull), 0)
        after = seen(new)
        # an empty mixture has no entropy, so it could look cheap: steps that empty one are too long
        down = (after[4] < now) & (after[2] > 1e-3 * floor)
        step = np.where(down, step * 1.1, step / 2)
        left = (new != x).any((0, 2)) if r % 8 == 7 else None
        x, bent, w = (np.where(down[:, None], n, o) for n, o in ((new, x), (after[0], bent), (after[1], w)))
        total, spread, now = (np.where(down, n, o) for n, o in zip(after[2:], (total, spread, now), strict=True))
        if left is not None and not left.all():
            done[:, going] = x
            going = going[left]
            if not len(going):
                break
            x, bent, rhs = (np.ascontiguousarray(v[:, left]) for v in (x, bent, rhs))
            w, total, spread, now, step = (v[left] for v in (w, total, spread, now, step))
    if len(going):
        done[:, going] = x
    return np.ascontiguousarray(done.transpose(1, 2, 0))


def residual(x: np.ndarray, space: np.ndarray, time: np.ndarray, rhs: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """Error of each spike, without its reconstruction."""
    return energy - 2 * (x * rhs).sum((1, 2)) + (x * curved(x, space, time)).sum((1, 2))


@dataclass
class Mixture:
    sites: np.ndarray  # (P, 3)
    widths: np.ndarray  # (P,)
    omega: np.ndarray  # (Q, T), unit rows
    kernel: str = "monopole"
    b: float = 2.0

    def slopes(self, dx: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Footprints (C, P), and their derivatives (4, C, P) in x, y, z and the width's softplus parameter."""
        r2 = (dx[:, None] - self.sites[:, 0]) ** 2 + (dy[:, None] - self.sites[:, 1]) ** 2
        z2, a, h = np.broadcast_to(self.sites[:, 2] ** 2, r2.shape), self.widths[None], 1e-20
        g = evaluate(self.kernel, r2, z2, a, self.b)
        by_r2 = evaluate(self.kernel, r2 + 1j * h, z2 + 0j, a + 0j, self.b).imag / h
        by_z2 = evaluate(self.kernel, r2 + 0j, z2 + 1j * h, a + 0j, self.b).imag / h
        by_a = evaluate(self.kernel, r2 + 0j, z2 + 0j, a + 1j * h, self.b).imag / h
        chain = 1 / (1 + np.exp(-inverse_softplus(np.maximum(self.widths - LEAST_WIDTH, 1e-6))))
        return g, np.stack([-2 * by_r2 * (dx[:, None] - self.sites[:, 0]), -2 * by_r2 * (dy[:, None] - self.sites[:, 1]), 2 * by_z2 * self.sites[:, 2], by_a * chain])


@dataclass
class Pass:
    sse: float
    energy: float
    gram: np.ndarray  # (Q, Q)
    cross: np.ndarray  # (Q, T)
    slope: np.ndarray  # (4, P)

    @property
    def nmse(self) -> float:
        return self.sse / max(self.energy, 1e-300)


def _offsets(spark) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Geometry of each channel, and the contacts' offsets of each geometry: spikes of one are solved together."""
    rows = geometry(spark).select("channel", "cfg", "dx", "dy").collect()
    of, offsets = np.zeros(1 + max(r["channel"] for r in rows), np.int64), {r["cfg"]: (np.array(r["dx"]), np.array(r["dy"])) for r in rows}
    for r in rows:
        of[r["channel"]] = r["cfg"]
    return of, [offsets[c] for c in sorted(offsets)]


def passed(spikes: DataFrame, model: Mixture, beta: float = 0.0, tol: float = 1e-7, kinds=None) -> Pass:
    """One job: every spike solved at these parameters, and the sums that all updates need; ``kinds`` are _offsets, if at hand."""
    (of, offsets), time = kinds or _offsets(spikes.sparkSession), model.omega @ model.omega.T
    p, (q, t), width = len(model.sites), model.omega.shape, 2000
    feet = [model.slopes(*o) for o in offsets]
    space = np.stack([g.T @ g for g, _ in feet])

    def run(batches):
        sse, energy, gram, cross, slope = 0.0, 0.0, np.zeros((q, q)), np.zeros((q, t)), np.zeros((4, p))
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, y = of[batch.column(0).to_numpy()], centred(batch.column(1))
            order = np.argsort(kind, kind="stable")
            kind, y = kind[order], y[order]
            groups = [(c, slice(*np.searchsorted(kind, (c, c + 1)))) for c in np.unique(kind)]
            # spikes of all geometries together: their steps are many and short, whatever their number
            unders = np.concatenate([np.matmul(feet[c][0].T, y[at]) for c, at in groups])
            rhs = unders @ model.omega.T
            if beta:
                xs = np.concatenate([entropic_mixture(space[c], time, rhs[at], beta) for c, at in groups])
            else:
                xs = np.concatenate([grid_mixture(space, time, rhs[i : i + width], rounds=1000, tol=tol, kind=kind[i : i + width]) for i in range(0, len(rhs), width)])
            for c, at in groups:
                own, x, under, (g, by) = y[at], xs[at], unders[at], feet[c]
                left = own - np.matmul(np.matmul(g, x), model.omega)
                sse, energy = sse + float((left * left).sum()), energy + float((own * own).sum())
                gram += np.einsum("bpq,pr,brs->qs", x, space[c], x, optimize=True)
                cross += np.einsum("bpq,bpt->qt", x, under)
                by_g = -2 * np.einsum("bct,qt,bpq->cp", left, model.omega, x, optimize=True)
                slope += np.einsum("cp,kcp->kp", by_g, by)
        flat = np.concatenate([[sse, energy], gram.ravel(), cross.ravel(), slope.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    v = np.zeros(2 + q * q + q * t + 4 * p)
    for r in spikes.select("channel", "w").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        v[r["i"]] = r["v"]
    one, two = 2 + q * q, 2 + q * q + q * t
    return Pass(v[0], v[1], v[2:one].reshape(q, q), v[one:two].reshape(q, t), v[two:].reshape(4, p))


def moved(model: Mixture, by: np.ndarray) -> Mixture:
    """The model after a step (4, P) in places and widths' parameters."""
    s = inverse_softplus(np.maximum(model.widths - LEAST_WIDTH, 1e-6)) + by[3]
    return replace(model, sites=model.sites + by[:3].T, widths=LEAST_WIDTH + softplus(s))


def reshaped(model: Mixture, sums: Pass) -> Mixture:
    """The shapes that fit best at the spikes' mixtures, of unit length; shapes that nothing uses stay."""
    new = np.linalg.lstsq(sums.gram + 1e-12 * np.eye(len(sums.gram)), sums.cross, rcond=None)[0]
    size = np.linalg.norm(new, axis=1, keepdims=True)
    return replace(model, omega=np.where(size > 1e-9, new / np.maximum(size, 1e-9), model.omega))


def _downhill(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], first: float) -> np.ndarray:
    """The quasi-Newton step from the last steps and the changes of slope along them; without any, one of that length down the slope."""
    by, shares = -slope, []
    for s, d in reversed(steps):
        shares.append((s * by).sum() / (s * d).sum())
        by = by - shares[-1] * d
    by = by * ((steps[-1][0] * steps[-1][1]).sum() / (steps[-1][1] ** 2).sum() if steps else first / max(np.linalg.norm(slope), 1e-300))
    for (s, d), share in zip(steps, reversed(shares)):
        by = by + s * (share - (d * by).sum() / (s * d).sum())
    return by


def fitted(spikes: DataFrame, start: Mixture, rounds: int | None = None, first: float = 4.0, least: float = 1e-5, patience: int = 3) -> tuple[Mixture, list[float]]:
    """Shapes with a step of places and widths, round by round; the error (nmse) after each, never rising.

    Ends when `patience` rounds in a row gained less than `least` each, or no step lowers the error; `rounds` may end it earlier. A round is
    one job, and another for each time that its step is shortened.
    """
    pool, kinds = spikes.select("channel", "w").persist(), _offsets(spikes.sparkSession)
    try:
        model, sums = start, passed(pool, start, kinds=kinds)
        errors, steps, few = [sums.nmse], [], 0
        while few < patience and (rounds is None or len(errors) <= rounds):
            slope = sums.slope / max(sums.energy, 1e-300)
            by = _downhill(slope, steps, first)
            by = by * min(1, 10 * first / max(np.abs(by).max(), 1e-300))
            shaped, share = reshaped(model, sums), 1.0
            while (after := passed(pool, tried := moved(shaped, share * by), kinds=kinds)).sse >= sums.sse and share > 1e-3:
                share *= 0.3
            if after.sse < sums.sse:
                bend = after.slope / max(after.energy, 1e-300) - slope
                if (share * by * bend).sum() > 1e-10 * np.linalg.norm(share * by) * np.linalg.norm(bend):
                    steps = [*steps, (share * by, bend)][-10:]
                few = few + 1 if sums.nmse - after.nmse < least else 0
                model, sums = tried, after
                errors.append(sums.nmse)
            elif steps:
                steps = []
            else:
                break
        return model, errors
    finally:
        pool.unpersist()


def solved(spikes: DataFrame, model: Mixture, beta: float = 0.0) -> DataFrame:
    """spike_id, channel, energy, sse, places (that hold over 1e-6 of the weight), entropy, off (departure from optimality over the
    largest right-hand side; of the plain problem, so it isn't small with an entropy term), x, y, z: the weighted place. Narrow."""
    (of, offsets), time = _offsets(spikes.sparkSession), model.omega @ model.omega.T
    schema = "spike_id long, channel int, energy double, sse double, places int, entropy double, off double, x double, y double, z double"

    def run(batches):
        for batch in batches:
            ids, channel, y = batch.column(0).to_numpy(), batch.column(1).to_numpy(), centred(batch.column(2))
            kind = of[channel]
            for c in np.unique(kind):
                own = np.flatnonzero(kind == c)
                g, _ = model.slopes(*offsets[c])
                space, rhs = g.T @ g, np.matmul(g.T, y[own]) @ model.omega.T
                x = entropic_mixture(space, time, rhs, beta) if beta else grid_mixture(space, time, rhs)
                energy = np.einsum("bct,bct->b", y[own], y[own])
                w = x.sum(2)
                total = w.sum(1)
                mean = (w @ model.sites) / np.maximum(total, 1e-300)[:, None]
                off = optimality(x, space, time, rhs) / np.maximum(np.abs(rhs).max((1, 2)), 1e-12)
                places = (w > 1e-6 * np.maximum(total, 1e-300)[:, None]).sum(1)
                cols = [ids[own], channel[own], energy, residual(x, space, time, rhs, energy), places, entropy(x), off, *mean.T]
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], [s.split()[0] for s in schema.split(", ")])

    return spikes.select("spike_id", "channel", "w").mapInArrow(run, schema)
