"""Volumes, motion end to end and blended axes against direct computation and planted truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import axes, drift, state, volumes
from tidemark.operators.learning import leading


def directly(a, b, most):
    out = np.zeros((len(a), len(b), *[2 * m + 1 for m in most]))
    for i, lx in enumerate(range(-most[0], most[0] + 1)):
        for j, ly in enumerate(range(-most[1], most[1] + 1)):
            for k, lz in enumerate(range(-most[2], most[2] + 1)):
                for x in range(a.shape[1]):
                    for y in range(a.shape[2]):
                        for z in range(a.shape[3]):
                            u, v, w = x + lx, y + ly, z + lz
                            if 0 <= u < a.shape[1] and 0 <= v < a.shape[2] and 0 <= w < a.shape[3]:
                                out[:, :, i, j, k] += a[:, u, v, w][:, None] * b[:, x, y, z][None]
    return out


@pytest.mark.parametrize("most", [(0, 0, 0), (0, 3, 0), (1, 2, 0), (1, 2, 1), (0, 0, 1)])
def test_frequency_domain_equals_direct(most):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3, 3, 6, 2)), rng.normal(size=(2, 3, 6, 2))
    assert np.allclose(volumes.correlations(a, b, most), directly(a, b, most), atol=1e-12)


def test_smoothing_is_separable_and_local():
    cells = [[{"v": (2 * 9 + 4) * 3 + 1, "w": 2.0}]]
    v = volumes.dense(cells, (5, 9, 3), (0.7, 1.0, 0.5))
    assert np.allclose(v[0], 2 * np.einsum("x,y,z->xyz", volumes.smoother(5, 0.7)[:, 2], volumes.smoother(9, 1.0)[:, 4], volumes.smoother(3, 0.5)[:, 1]))
    assert np.allclose(volumes.smoother(41, 1.0)[:, 20].sum(), 1) and volumes.smoother(9, 1.0)[0, 4] == 0


@pytest.mark.parametrize("block", [3, 50])
def test_registered_volumes(spark, block):
    rng = np.random.default_rng(1)
    g = volumes.Grid((0.0, 0.0, 0.0), (10.0, 10.0, 10.0), (3, 12, 2))
    base = [(rng.random() * 30, 30 + rng.random() * 60, rng.random() * 20) for _ in range(40)]
    rows = [(b + 0.5, x, y + 10.0 * (b % 3), z) for b in range(7) for x, y, z in base] + [(20.5, 5.0, 500.0, 5.0)]
    events = spark.createDataFrame(rows, "t double, x double, y double, z double")
    v = volumes.volumes(events, g, 1.0)
    assert v.count() == 7  # an event outside the grid has no volume
    got = volumes.registered(v, g, (0, 3, 0), block=block).collect()
    assert len(got) == 21 and all(r.d == 10.0 * (r.t % 3 - r.u % 3) and r.c > 0.9 and r.dx == 0 for r in got)
    dense = {r.bin: volumes.normalised(volumes.dense([[c.asDict() for c in r.voxels]], (3, 12, 2))) for r in v.collect()}
    for r in got[:6]:
        want = directly(dense[r.t], dense[r.u], (0, 3, 0))[0, 0, 0, :, 0]
        w = np.exp((want - want.max()) / 0.05)
        assert abs(want.max() - r.c) < 1e-9 and abs((w * np.arange(-3, 4)).sum() / w.sum() * 10 - r.soft_d) < 1e-9
    assert volumes.volumes(events, g, 1.0, every=2).count() == 4
    assert volumes.registered(volumes.volumes(events.limit(0), g, 1.0), g, (0, 3, 0)).count() == 0
    near = volumes.registered(v, g, (0, 3, 0), block=block, frame=2).collect()
    assert {(r.t, r.u) for r in near} == {(r.t, r.u) for r in got if r.t - r.u <= 2}


def moving(spark, seed=2, n=24_000):
    """Units at fixed depths and amplitudes, all moved by a common drift."""
    rng = np.random.default_rng(seed)
    unit = rng.integers(0, 25, n)
    depth, amp = rng.random(25) * 300, np.exp(rng.random(25) * 4)
    t = rng.random(n) * 1000
    shift = 30 * np.sin(t / 160) + 0.01 * t
    y = depth[unit] + shift + rng.normal(size=n) * 2
    a = amp[unit] * np.exp(0.1 * rng.normal(size=n))
    df = spark.createDataFrame([(float(x), float(d), float(v)) for x, d, v in zip(t, y, a)], "t double, y double, amp double")
    return df, 30 * F.sin(F.col("t") / 160) + 0.01 * F.col("t")


def test_planted_drift_is_recovered(spark, tmp_path):
    events, truth = moving(spark)
    c = drift.Config(time_bin=20.0, y_lo=-60.0, y_hi=400.0, windows=3)
    track = drift.estimated(events, c)
    state.save(track, "motion", f"file://{tmp_path}/motion")
    back = state.load(spark, "motion", f"file://{tmp_path}/motion")
    scores = {r.win: r for r in drift.scored(back, truth).collect()}
    assert set(scores) == {0, 1, 2, 3} and scores[0].r > 0.99 and abs(scores[0].gain - 1) < 0.05 and scores[0].rmse < 2
    best = drift.best_window(drift.scored(back, truth)).collect()
    assert len(best) == 1 and best[0].r == max(scores[w].r for w in (1, 2, 3)) and best[0].r > 0.9
    rows = {r.kind: r for r in drift.metrics(events, c, truth, bounds=(120.0, 180.0)).collect()}
    assert set(rows) == {"rigid", "nonrigid", "clamped"} and rows["clamped"].r < rows["rigid"].r - 0.02
    # a track that doesn't move has no correlation
    flat = drift.scored(back.withColumn("p", F.lit(1.0)), truth).where("win = 0").first()
    assert flat.r is None or flat.r != flat.r


def test_drift_of_few_events_and_contradictions(spark):
    events, _ = moving(spark, n=50)
    assert drift.estimated(events.limit(0), drift.Config()).count() == 0
    assert drift.histogram(events, drift.Config(y_lo=0.0, y_hi=100.0, most_lag=40.0)).count() <= 50
    for bad in (dict(time_bin=0.0), dict(y_hi=-1.0), dict(windows=0), dict(most_lag=1000.0)):
        with pytest.raises(ValueError):
            drift.Config(**bad).checked()


def test_piecewise(spark):
    knots = ((0.0, 1.0), (2.0, 5.0), (6.0, -3.0))
    t = [-1.0, 0.0, 0.5, 2.0, 3.0, 6.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t double").select(drift.piecewise(knots, F.col("t"))).collect()]
    assert np.allclose(got, np.interp(t, *zip(*knots)))


# blended axes


def rows_with_axes(seed=3, n=3000):
    rng = np.random.default_rng(seed)
    y = rng.random(n) * 400
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    v = (rng.normal(size=(n, 6)) * [3, 2, 1, 0.3, 0.2, 0.1] + y[:, None] * [0.01, 0, 0, 0, 0, 0]) @ turn
    return y, v


def test_blended_axes_equal_numpy(spark):
    y, v = rows_with_axes()
    blocks = axes.Blocks(0.0, 100.0, 100.0, 5)
    df = spark.createDataFrame([(i, float(a), b.tolist()) for i, (a, b) in enumerate(zip(y, v))] + [(-1, None, [1.0] * 6), (-2, 3.0, None), (-3, 900.0, [1.0] * 6)], "id long, y double, v array<double>")
    got = {r.id: (r.blocks, r.s0, r.s1, r.s2) for r in axes.blended(df, "id", "y", "v", blocks, 6, least=500).collect()}
    u = np.concatenate([v, np.ones((1, 6))])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    target = leading(np.cov(u.T, bias=True), 3)
    u, score, weight = u[: len(y)], np.zeros((len(y), 3)), np.zeros(len(y))
    for c in blocks.centres:
        inside = np.abs(y - c) < 100
        own = u[inside] if inside.sum() >= 500 else np.concatenate([u, np.ones((1, 6)) / np.sqrt(6)])
        mean, cov = own.mean(0), np.cov(own.T, bias=True)
        local = leading(cov, 3)
        p, _, q = np.linalg.svd(local @ target.T)
        local = (p @ q).T @ local
        s = ((u - mean) @ local.T) / np.sqrt(np.einsum("kd,de,ke->k", local, cov, local))
        w = np.where(inside, 1 - np.abs(y - c) / 100 + 1e-3, 0)
        score, weight = score + w[:, None] * s, weight + w
    assert set(got) == set(range(len(y)))
    assert all(np.allclose(got[i][1:], score[i] / weight[i], atol=1e-7) for i in range(len(y)))


def test_alignment_forgets_signs_and_order():
    rng = np.random.default_rng(4)
    local, target = (np.linalg.qr(rng.normal(size=(8, 3)))[0].T for _ in range(2))
    want = axes.aligned(local, target)
    for turn in (np.diag([-1, 1, -1]), np.eye(3)[[2, 0, 1]], np.linalg.qr(rng.normal(size=(3, 3)))[0]):
        assert np.allclose(axes.aligned(turn @ local, target), want)
    assert np.allclose(axes.aligned(np.diag([1, -1, 1]) @ target, target), target)
