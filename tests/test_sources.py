"""Beam inference, exact weights, candidate dictionaries and packed assignment against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.kernels import KERNELS, evaluate
from tidemark.operators import beam, candidates, inference, packed, solvers
from tidemark.sources import recording as R

SF = "/root/testdata/sf0.001"


def world(seed, n=9, m=3, b=40):
    rng = np.random.default_rng(seed)
    h = rng.random((8, n)) + 0.1
    h /= np.linalg.norm(h, axis=0)
    return h.T @ h, rng.normal(size=(n, 3)) * 10, np.einsum("cn,bcm->bnm", h, rng.normal(size=(b, 8, m)))


def captured_by(over, u, places):
    g = over[np.ix_(places, places)]
    return float(np.einsum("rm,rm->", np.linalg.solve(g, u[list(places)]), u[list(places)]))


@pytest.mark.parametrize("r", [2, 3, 4])
def test_wide_beam_is_exhaustive(r):
    over, places, u = world(r)
    o = beam.Options(beam=200, apart=3.0, most_condition=200.0, least_share=0.0, min_gain=-1.0)
    got = beam.Beam(over, places, beam.Model(False, r), o).run(u, np.full(len(u), 1e9))
    near = np.linalg.norm(places[:, None] - places[None], axis=2)
    for i in range(len(u)):
        best = -1.0, None
        for s in itertools.combinations(range(9), r):
            e = np.linalg.eigvalsh(over[np.ix_(s, s)])
            if all(near[a, b] >= 3 for a, b in itertools.combinations(s, 2)) and e[-1] / e[0] <= 200:
                best = max(best, (captured_by(over, u[i], s), s))
        if (got[0][i] >= 0).all():
            assert sorted(got[0][i]) == list(best[1]) and abs(got[2][i] - best[0]) < 1e-8
            # coefficients are the joint refit
            x = np.linalg.solve(over[np.ix_(got[0][i], got[0][i])], u[i][got[0][i]])
            assert np.allclose(x, got[1][i], atol=1e-6)


@pytest.mark.parametrize("r", [2, 3, 4])
def test_exact_shared_weights(r):
    over, _, u = world(10 + r, n=r, b=200)
    w, got = solvers.shared_best(np.matmul(u, u.transpose(0, 2, 1)), np.broadcast_to(over, (len(u), r, r)))
    assert (w >= 0).all() and np.allclose(w.sum(1), 1) and np.allclose(solvers.shared_captured(w, u, np.broadcast_to(over, (len(u), r, r))), got, rtol=1e-6)
    rng = np.random.default_rng(0)
    for x in np.concatenate([rng.dirichlet(np.full(r, 0.4), 3000), np.eye(r)]):
        tried = solvers.shared_captured(np.broadcast_to(x, (len(u), r)), u, np.broadcast_to(over, (len(u), r, r)))
        assert (tried <= got + 1e-6).all()
    if r == 2:
        bounded = solvers.shared_pair(u[:, 0], u[:, 1], np.full(len(u), over[0, 1]), 0.1)
        ws = np.linspace(0.1, 0.9, 4001)
        for i in range(0, len(u), 20):
            grid = [solvers.shared_captured(np.array([[x, 1 - x]]), u[i : i + 1], over[None])[0] for x in ws]
            assert 0.1 <= bounded[0][i] <= 0.9 and bounded[1][i] >= max(grid) - 1e-9


def test_shared_beam_against_all_supports():
    over, places, u = world(5, n=7, b=25)
    o = beam.Options(beam=50, shortlist=7, apart=0.0, most_condition=1e9, least_share=0.0, min_gain=-1.0)
    for r in (2, 3):
        place, coef, got, *_ = beam.Beam(over, places, beam.Model(True, r), o).run(u, np.full(len(u), 1e9))
        for i in range(len(u)):
            best = 0.0
            for s in itertools.combinations(range(7), r):
                us = u[i : i + 1, list(s)]
                best = max(best, solvers.shared_best(np.matmul(us, us.transpose(0, 2, 1)), over[np.ix_(s, s)][None])[1][0])
            on = place[i] >= 0
            assert abs(got[i] - best) < 1e-7
            x, p = coef[i][on], place[i][on]
            assert abs(2 * (x * u[i][p]).sum() - np.einsum("rm,rs,sm->", x, over[np.ix_(p, p)], x) - got[i]) < 1e-6


def test_leave_one_out_is_true():
    over, places, u = world(8)
    o = beam.Options(beam=20, apart=0.0, most_condition=1e9, least_share=0.0, min_gain=-1.0)
    place, coef, got, *_ = beam.Beam(over, places, beam.Model(False, 3), o).run(u, np.full(len(u), 1e9))
    still, again = beam.losses(over, u, place, coef, False)
    for i in range(len(u)):
        for r in range(3):
            rest = [p for j, p in enumerate(place[i]) if j != r]
            assert abs(again[i, r] - (captured_by(over, u[i], place[i]) - captured_by(over, u[i], rest))) < 1e-6
            x = coef[i].copy()
            x[r] = 0
            gap = got[i] - (2 * (x * u[i][place[i]]).sum() - np.einsum("rm,rs,sm->", x, over[np.ix_(place[i], place[i])], x))
            assert abs(still[i, r] - gap) < 1e-6 and still[i, r] >= again[i, r] - 1e-6


def test_screening_changes_nothing():
    over, places, u = world(9, b=200)
    energy = np.einsum("bnm,bnm->b", u, u) / 9 + np.einsum("bnm,bnm->bn", u, u).max(1)
    o = beam.Options(min_gain=float(np.median(energy)) / 3)
    model = beam.Beam(over, places, beam.MODELS["m2_r2"], o)
    some, every = model.run(u, np.einsum("bnm,bnm->bn", u, u).max(1) + o.min_gain * 0.9), model.run(u, np.full(len(u), 1e9))
    assert not some[5].any() and every[5].all() and (some[0][:, 1] == -1).all()


def test_beam_queries_equal_the_pair_search(spark):
    s = R.spikes(spark, SF)
    wide = beam.sources(s, "m2_r2", options=beam.Options(beam=27, apart=0.0, most_condition=1e12, least_share=0.0, min_gain=-1.0)).where("rank = 0").select("spike_id", "captured")
    pairs = inference.pair_search(s).select("spike_id", F.col("captured").alias("want"))
    worst = wide.join(pairs, "spike_id").agg(F.max(F.abs(F.col("captured") - F.col("want")) / (1 + F.col("want"))).alias("d"), F.count(F.lit(1)).alias("n")).first()
    assert worst["n"] == s.count() and worst["d"] < 1e-6
    assert beam.sources(s.limit(0), "m2_r3").count() == 0
    with pytest.raises(ValueError, match="unknown model"):
        beam.sources(s, "m3")


@pytest.mark.parametrize("model", sorted(beam.MODELS))
def test_every_model_keeps_its_contract(spark, model):
    s = R.spikes(spark, SF).limit(300)
    rows = beam.sources(s, model, options=beam.Options(beam=4, shortlist=6, min_gain=0.2)).collect()
    kind, by = beam.MODELS[model], {}
    for r in rows:
        by.setdefault(r.spike_id, []).append(r)
    assert len(by) == 300
    for own in by.values():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(own[0].support)) and len(own) <= kind.sources and len({r.n for r in own}) == len(own)
        assert all(a.amp >= b.amp - 1e-9 for a, b in zip(own, own[1:])) and abs(sum(r.share for r in own) - 1) < 1e-9 or own[0].amp == 0
        assert own[0].captured <= own[0].energy + 1e-9
        if kind.equal and len(own) == 2:
            assert abs(own[0].share - 0.5) < 1e-9
        if kind.least and len(own) == 2:
            assert own[1].share >= kind.least - 1e-9


# candidates and packed forms


def test_kernels_agree_on_arrays(spark):
    rng = np.random.default_rng(1)
    r2, z2 = rng.random(50) * 900, rng.random(50) * 400
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(r2, z2)], "r2 double, z2 double")
    got = df.select(*[KERNELS[k](F.col("r2"), F.col("z2"), 12.0, 3.0).alias(k) for k in KERNELS]).toPandas()
    for k in KERNELS:
        assert np.allclose(got[k], evaluate(k, r2, z2, 12.0, 3.0), rtol=1e-12)


def test_cells_and_profiles():
    for k in (8, 64, 500, 4096, 40_000):
        nx, ny, nz = candidates.cells_for(k)
        assert abs(nx * ny * nz - k) <= max(4, 0.12 * k) and nx >= ny >= 2 and nz >= 2
    g = candidates.lattice(5)
    assert g.shape == (125, 3) and g[0].tolist() == [-150, -150, 1] and np.allclose(g[4], [-150, -150, 300]) and np.allclose(g[1:5, 2] / g[:4, 2], 300**0.25)
    p = candidates.profiles(["monopole", "power", "gauss_aniso"], 10, 3, (1.0, 2.0, 4.0))
    assert len(p) == 10 + 30 + 9 and p[10:13] == [("power", 1.0, 1.0), ("power", 1.0, 2.0), ("power", 1.0, 4.0)]
    assert [round(x[1]) for x in p[:10]] == [2**i for i in range(10)] and p[-1][1:] == (512.0, 512.0)


def test_packed_scores_are_direct_scores():
    rng = np.random.default_rng(3)
    wide = candidates.Candidates(candidates.lattice(16), candidates.profiles(["monopole", "gauss_aniso"], 2, 1, lo=20.0, hi=60.0)[:3] + [("exp", 25.0, 2.0)])
    assert len(wide) == 16**3 * 4
    dx, dy = rng.normal(size=8) * 30, rng.normal(size=8) * 30
    y, omega = rng.normal(size=(60, 8, 8)), rng.normal(size=(3, 8))
    k, score = packed.best(packed.pack_forms(y, packed.whitener(omega)), wide, dx, dy)
    g = wide.footprints(dx, dy)
    b = np.einsum("kc,sct,mt->skm", g, y, omega)
    want = np.einsum("skm,skm->sk", np.linalg.solve(omega @ omega.T + 1e-6 * np.eye(3), b.transpose(0, 2, 1)).transpose(0, 2, 1), b)
    assert (k == np.round(want, 9).argmax(1)).all() and np.allclose(score, want.max(1), rtol=1e-9)
    v, got = packed.hard_coefficients(y, g[k], omega)
    assert np.allclose(got, score, rtol=1e-9)
    left = ((y - g[k][:, :, None] * (v @ omega)[:, None]) ** 2).sum((1, 2))
    assert np.allclose(left, (y**2).sum((1, 2)) - got, rtol=1e-4)
    # equal candidates: the smaller one, also across blocks
    twice = candidates.Candidates(np.concatenate([wide.sites[:50], wide.sites[:50]]), wide.profiles)
    a, b = packed.best(packed.pack_forms(y, omega), twice, dx, dy, block=64, slice_=7), packed.best(packed.pack_forms(y, omega), twice, dx, dy)
    assert (a[0] < 200).all() and (a[0] == b[0]).all() and np.allclose(a[1], b[1])


def test_packed_assignment_equals_the_narrow_one(spark):
    s = R.spikes(spark, SF)
    small = candidates.Candidates(np.array(inference.LATTICE), [("monopole", 15.0, 2.0)])
    a = packed.assigned(packed.forms(s, inference.dct(4)), small).select("spike_id", "k", "score")
    b = inference.assigned(s).select("spike_id", F.element_at("top", 1).alias("t"))
    j = a.join(b, "spike_id").select((F.col("k") == F.col("t.n")).alias("same"), F.abs(F.col("score") - F.col("t.score")).alias("d")).collect()
    assert len(j) == 1000 and sum(r.same for r in j) > 990 and max(r.d for r in j) < 1e-3
    assert packed.assigned(packed.forms(s.limit(0), inference.dct(4)), small).count() == 0


def test_candidate_table(spark):
    c = candidates.Candidates(candidates.grid(2, 3, 2), [("gauss", 5.0, 2.0), ("dog", 9.0, 1.5)])
    rows = c.table(spark).orderBy("k").collect()
    assert [(r.k, r.site, r.profile) for r in rows] == [(k, k // 2, k % 2) for k in range(24)]
    assert all(np.allclose([r.x, r.y, r.z], c.sites[r.site]) and (r.kernel, r.a, r.b) == c.profiles[r.profile] for r in rows)
