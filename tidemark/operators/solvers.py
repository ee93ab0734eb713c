"""Small convex and closed-form solvers for batches of spikes, in numpy, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np


def project_simplex(x: np.ndarray) -> np.ndarray:
    """Rows of x moved to the nearest non-negative rows of sum 1: a common amount comes off, and what falls below 0 is 0."""
    lo, hi = x.min(1) - 1.0, x.max(1)
    for _ in range(80):  # the sum over what stays is decreasing in the amount: bisection to machine precision
        mid = (lo + hi) / 2
        many = np.maximum(x - mid[:, None], 0).sum(1) > 1
        lo, hi = np.where(many, mid, lo), np.where(many, hi, mid)
    out = np.maximum(x - hi[:, None], 0)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def shared_captured(weights: np.ndarray, u: np.ndarray, over: np.ndarray) -> np.ndarray:
    """What a mixture of footprints with one common shape captures: |sum w u|^2 / (w' H w); u (B, R, M), over (B, R, R)."""
    v = np.einsum("br,brm->bm", weights, u)
    return np.einsum("bm,bm->b", v, v) / np.maximum(np.einsum("br,brs,bs->b", weights, over, weights), 1e-12)


def shared_pair(u1: np.ndarray, u2: np.ndarray, c: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weight in [least, 1 - least] of the first of two footprints of overlap c that captures most with one common shape, and that much.

    With s1, s2 and x the norms and the inner product of the u, the ratio's derivative vanishes at the roots of a quadratic;
    the best of those inside and of both ends is exact.
    """
    s1, s2, x = (u1 * u1).sum(1), (u2 * u2).sum(1), (u1 * u2).sum(1)
    # w u1 + (1-w) u2: numerator a w^2 + b w + s2, denominator d w^2 - d w + 1
    a, b, d = s1 + s2 - 2 * x, 2 * (x - s2), 2 * (1 - c)
    p, q, r = -d * (a + b), 2 * (a - d * s2), b + d * s2
    root = np.sqrt(np.maximum(q * q - 4 * p * r, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        tries = [np.where(np.abs(p) > 1e-12, (-q + k * root) / (2 * p), -r / q) for k in (1, -1)]
    tries = [np.clip(np.nan_to_num(t, nan=0.0, posinf=0.0, neginf=0.0), least, 1 - least) for t in tries] + [np.full_like(c, 1 - least), np.full_like(c, least)]
    got = np.stack([(a * w * w + b * w + s2) / np.maximum(d * w * w - d * w + 1, 1e-12) for w in tries])
    best = np.round(got, 12).argmax(0)
    return np.stack(tries)[best, np.arange(len(c))], got.max(0)


def shared_best(inner: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (B, R), non-negative of sum 1, that capture most with one common shape, and that much; inner (B, R, R) = u u'.

    The ratio w' inner w / w' over w is stationary inside a face of the simplex where w is an eigenvector of that face's pencil. So
    the best eigenvector of one sign over all 2**R - 1 faces is the maximum; single footprints are faces too.
    """
    b, r, _ = inner.shape
    weights, most = np.zeros((b, r)), np.full(b, -np.inf)
    for on in ([j for j in range(r) if mask >> j & 1] for mask in range(1, 1 << r)):
        low = np.linalg.cholesky(over[:, on][:, :, on] + 1e-10 * np.eye(len(on)))
        turned = np.linalg.solve(low, inner[:, on][:, :, on])
        value, vector = np.linalg.eigh(np.linalg.solve(low, turned.transpose(0, 2, 1)))
        x = np.linalg.solve(low.transpose(0, 2, 1), vector)
        x = x * np.sign(x.sum(1, keepdims=True))
        value = np.where((x >= 0).all(1), value, -np.inf)
        best = value.argmax(1)
        got = value[np.arange(b), best]
        better = got > most + 1e-12
        full = np.zeros((b, r))
        w = x[np.arange(b), :, best]
        full[:, on] = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        weights, most = np.where(better[:, None], full, weights), np.where(better, got, most)
    return weights, most


def leading_pair(inner: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of w' inner w / w' over w without a sign constraint, and its w (B, K), of sum 0 or more."""
    k = inner.shape[1]
    low = np.linalg.cholesky(over + 1e-10 * np.eye(k))
    # a few columns: substitution over the whole batch is cheaper than a solve for each
    turned = inner.copy()
    for _ in range(2):
        for i in range(k):
            for j in range(i):
                turned[:, i] -= low[:, i, j, None] * turned[:, j]
            turned[:, i] /= low[:, i, i, None]
        turned = np.ascontiguousarray(turned.transpose(0, 2, 1))
    if k == 2:
        half, side = (turned[:, 0, 0] - turned[:, 1, 1]) / 2, (turned[:, 0, 1] + turned[:, 1, 0]) / 2
        reach = np.hypot(half, side)
        top = (turned[:, 0, 0] + turned[:, 1, 1]) / 2 + reach
        w = np.stack([np.where(half >= 0, half + reach, side), np.where(half >= 0, side, reach - half)], 1)
        w[reach == 0] = (1, 0)
    else:
        value, vector = np.linalg.eigh(turned)
        top, w = value[:, -1], vector[:, :, -1].copy()
    for i in range(k - 1, -1, -1):
        for j in range(i + 1, k):
            w[:, i] -= low[:, j, i] * w[:, j]
        w[:, i] /= low[:, i, i]
    return top, w * np.where(w.sum(1) < 0, -1.0, 1.0)[:, None]


def shared_sets(u: np.ndarray, over: np.ndarray, spike: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shared_best of sets of places (X, R), sorted, of the spikes (X,); u (B, N, M), over (N, N).

    A face's unconstrained optimum bounds those of all faces inside it, and is the best of them if it has one sign. So smaller faces are
    asked only where it has not, and each once a spike however many sets hold it.
    """
    x, k = sets.shape
    if k == 1:
        own = u[spike, sets[:, 0]]
        return np.ones((x, 1)), np.einsum("bm,bm->b", own, own) / (over[sets[:, 0], sets[:, 0]] + 1e-10)
    own = u[spike[:, None], sets]
    inner, gram = np.matmul(own, own.transpose(0, 2, 1)), over[sets[:, :, None], sets[:, None]]
    value, w = leading_pair(inner, gram)
    weights = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    rest = np.flatnonzero(~(w >= 0).all(1))
    if not len(rest):
        return weights, value
    sub = np.stack([np.delete(sets[rest], j, 1) for j in range(k)], 1).reshape(-1, k - 1)
    of = np.repeat(spike[rest], k)
    key = of.astype(np.int64)
    for j in range(k - 1):
        key = key * over.shape[0] + sub[:, j]
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    less, got = shared_sets(u, over, of[first], sub[first])
    got = got[back].reshape(-1, k)
    best = got.argmax(1)
    here = np.arange(len(rest))
    less = less[back].reshape(-1, k, k - 1)[here, best]
    full = np.zeros((len(rest), k))
    np.put_along_axis(full, (np.arange(k - 1)[None] + (np.arange(k - 1)[None] >= best[:, None])), less, 1)
    weights[rest], value[rest] = full, got[here, best]
    return weights, value


def shared_weights(u: np.ndarray, over: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights on the simplex that capture most with one common shape, by projected ascent with halving steps; never worse than
    the best single footprint, where it starts."""
    b, r, _ = u.shape
    single = np.einsum("brm,brm->br", u, u) / np.maximum(np.einsum("brr->br", over), 1e-12)
    w = np.eye(r)[single.argmax(1)] * 0.9 + 0.1 / r
    start = np.eye(r)[single.argmax(1)]
    w = np.where((shared_captured(w, u, over) > single.max(1))[:, None], w, start)
    now, step = shared_captured(w, u, over), np.full(b, 0.5)
    for _ in range(steps):
        v = np.einsum("br,brm->bm", w, u)
        norm = np.maximum(np.einsum("br,brs,bs->b", w, over, w), 1e-12)
        slope = 2 * (np.einsum("brm,bm->br", u, v) - now[:, None] * np.einsum("brs,bs->br", over, w)) / norm[:, None]
        slope /= np.maximum(np.abs(slope).max(1, keepdims=True), 1e-12)
        new = project_simplex(w + step[:, None] * slope)
        got = shared_captured(new, u, over)
        up = got > now
        w, now = np.where(up[:, None], new, w), np.where(up, got, now)
        step = np.where(up, step * 1.2, step / 2)
    return w


def accelerated(gram: np.ndarray, rhs: np.ndarray, shrink, rounds: int) -> np.ndarray:
    """Minimises x'Gx / 2 - x'b + penalty for a batch by accelerated proximal steps of length 1 / |G|_F, with restarts."""
    length = 1 / np.maximum(np.sqrt((gram * gram).sum((1, 2))), 1e-12)
    wide = length.reshape(-1, *[1] * (rhs.ndim - 1))
    x, y, k = np.zeros_like(rhs), np.zeros_like(rhs), np.ones(len(rhs))
    for _ in range(rounds):
        slope = (np.matmul(gram, y) if y.ndim == 3 else np.matmul(gram, y[..., None])[..., 0]) - rhs
        new = shrink(y - wide * slope, length)
        turn = ((y - new) * (new - x)).reshape(len(x), -1).sum(1) > 0
        k = np.where(turn, 1.0, k)
        after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        y = new + ((k - 1) / after).reshape(wide.shape) * (new - x)
        x, k = new, after
    return x


def nonnegative_mixture(gram: np.ndarray, rhs: np.ndarray, l1: float = 0.0, rounds: int = 300) -> np.ndarray:
    """Non-negative x that minimises x'Gx / 2 - x'b + l1 sum(x)."""
    return accelerated(gram, rhs - l1, lambda z, _: np.maximum(z, 0), rounds)


def group_shrink(z: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each row of z (B, N, M) shortened by `by`; shorter rows vanish."""
    norm = np.sqrt((z * z).sum(2, keepdims=True))
    return z * np.maximum(1 - by[:, None, None] / np.maximum(norm, 1e-12), 0)


def group_lasso(gram: np.ndarray, rhs: np.ndarray, lam: float, rounds: int = 400) -> np.ndarray:
    """Coefficients (B, N, M) of least squares over places with the norms of their rows penalised by lam."""
    return accelerated(gram, rhs, lambda z, length: group_shrink(z, lam * length), rounds)


def group_lasso_shared(gram: np.ndarray, rhs: np.ndarray, lam: float, rounds: int = 400, block: int = 256) -> np.ndarray:
    """group_lasso for spikes that share one Gram matrix (N, N): a round is one plain product for a block of spikes, which stays in the cache,
    and spikes that have come to rest, to the last bit, take no more of them."""
    if len(rhs) > block:
        return np.concatenate([group_lasso_shared(gram, rhs[i : i + block], lam, rounds, block) for i in range(0, len(rhs), block)])
    length = 1 / max(np.sqrt((gram * gram).sum()), 1e-12)
    b, n, m = rhs.shape
    rhs, out = np.ascontiguousarray(rhs.transpose(2, 0, 1)) * length, np.zeros((m, b, n))
    step, going = np.eye(n) - length * gram, np.arange(b)
    x, y, k = np.zeros_like(rhs), np.zeros_like(rhs), np.ones(b)
    for r in range(rounds):
        z = (y.reshape(-1, n) @ step).reshape(y.shape) + rhs
        norm = np.sqrt(np.einsum("mbn,mbn->bn", z, z))
        new = z * np.maximum(1 - lam * length / np.maximum(norm, 1e-12), 0)
        moved = new - x
        k = np.where(np.einsum("mbn,mbn->b", y - new, moved) > 0, 1.0, k)
        after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        still = r % 10 == 9 and ~moved.any((0, 2)) & (np.einsum("mbn,mbn->b", y - x, y - x) == 0)
        y = new + ((k - 1) / after)[:, None] * moved
        x, k = new, after
        if np.any(still):
            out[:, going[still]] = x[:, still]
            going, x, y, k, rhs = going[~still], x[:, ~still], y[:, ~still], k[~still], rhs[:, ~still]
            if not len(going):
                break
    out[:, going] = x
    return np.ascontiguousarray(out.transpose(1, 2, 0))


def project_cone(vectors: np.ndarray, axis: np.ndarray, degrees: float) -> np.ndarray:
    """Unit vectors no further than `degrees` from the unit axis. Cones are one-sided: a vector against the axis is turned round first, so
    that atoms keep the axis' polarity; those still outside turn towards it, in the plane of both. A zero vector becomes the axis."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    v = v * np.where(v @ axis < 0, -1.0, 1.0)[:, None]
    along = v @ axis
    side = v - along[:, None] * axis
    size = np.linalg.norm(side, axis=1, keepdims=True)
    rad = np.radians(degrees)
    rim = np.where(size > 1e-9, np.cos(rad) * axis + np.sin(rad) * side / np.maximum(size, 1e-12), axis)
    return np.where((along >= np.cos(rad))[:, None], v, rim)


def polarised(prototypes: np.ndarray) -> np.ndarray:
    """Prototypes turned so that the largest extremum of even ones is positive and that of odd ones negative."""
    peak = prototypes[np.arange(len(prototypes)), np.abs(prototypes).argmax(1)]
    want = np.where(np.arange(len(prototypes)) % 2 == 0, 1.0, -1.0)
    return prototypes * np.where(np.sign(peak) * want < 0, -1.0, 1.0)[:, None]


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 25, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """k unit centres of unit vectors by cosine, and each vector's centre. Centres start far apart; an empty one keeps its place."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centres = v[[np.random.default_rng(seed).integers(len(v))]]
    while len(centres) < k:
        centres = np.concatenate([centres, v[[np.abs(v @ centres.T).max(1).argmin()]]])
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, v)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return centres, (v @ centres.T).argmax(1)
