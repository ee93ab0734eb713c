"""What keeps the heavy queries within their limits: spread work, exact short cuts, one pass in place of several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import codebook, inference, mixtures, motion, packed, solvers, state
from tidemark.operators.candidates import Candidates
from tidemark.session import kept
from tidemark.sources import recording as R

SF = "/root/testdata/sf0.001"


def test_spikes_are_dealt_whatever_the_scan(spark):
    # one small file is a task or two of a scan
    large = SF.replace("sf0.001", "sf0.1")
    assert R.spikes(spark, large).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert R.spikes(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_active_sets_end_at_the_optimum_without_steps():
    rng = np.random.default_rng(3)
    g = rng.random((8, 12))  # more places than contacts: the matrix is singular
    omega = rng.normal(size=(3, 8))
    space, time = g.T @ g, omega @ omega.T
    rhs = np.matmul(g.T, rng.normal(size=(200, 8, 8))) @ omega.T
    rhs[0] = 0
    rhs[1] = -np.abs(rhs[1])
    x = mixtures.grid_mixture(space, time, rhs, rounds=0)
    scale = np.maximum(np.abs(rhs).max((1, 2)), 1e-12)
    assert (x >= 0).all() and not x[:2].any() and (mixtures.optimality(x, space, time, rhs) <= 1e-9 * scale).mean() > 0.95
    x = mixtures.grid_mixture(space, time, rhs)
    dense = inference.pivoted_nonnegative(np.broadcast_to(np.kron(space, time), (200, 36, 36)), rhs.reshape(200, -1))[1]
    got = 2 * (x * rhs).sum((1, 2)) - (x * mixtures.curved(x, space, time)).sum((1, 2))
    assert np.allclose(got, dense, atol=1e-6)


def test_sets_are_scored_by_the_faces_that_can_win():
    rng = np.random.default_rng(4)
    h = rng.random((8, 9))
    h /= np.linalg.norm(h, axis=0)
    over, u = h.T @ h, rng.normal(size=(50, 9, 4))
    u[:10] = np.abs(u[:10])
    for r in (1, 2, 3, 4):
        spike = np.repeat(np.arange(50), 6)
        sets = np.sort(np.stack([rng.choice(9, r, replace=False) for _ in spike]), axis=1)
        w, got = solvers.shared_sets(u, over, spike, sets)
        own, gram = u[spike[:, None], sets], over[sets[:, :, None], sets[:, None]]
        want = solvers.shared_best(np.matmul(own, own.transpose(0, 2, 1)), gram)
        assert np.allclose(got, want[1], rtol=1e-9) and np.allclose(w, want[0], atol=1e-5) and np.allclose(solvers.shared_captured(w, own, gram), got, rtol=1e-6)


def test_channels_of_one_geometry_are_searched_together(spark):
    shapes = inference.shapes_by_channel(spark)
    of, first = inference.by_geometry(shapes)
    assert len(first) == 15 and np.array_equal(shapes[first[of]], shapes)


def test_group_lasso_of_one_geometry():
    rng = np.random.default_rng(5)
    h = rng.random((8, 9))
    gram, rhs = h.T @ h, rng.normal(size=(60, 9, 4))
    rhs[:20] *= 1e-3
    for rounds in (7, 150, 3000):
        x = solvers.group_lasso_shared(gram, rhs, 0.4, rounds, block=25)
        assert np.allclose(x, solvers.group_lasso(np.broadcast_to(gram, (60, 9, 9)), rhs, 0.4, rounds), atol=1e-12) and not x[:20].any()


def test_ties_of_candidates_go_to_the_smallest():
    rng = np.random.default_rng(6)
    sites = rng.normal(size=(40, 3)) * 30 + (0, 0, 40)
    wide = Candidates(np.concatenate([sites, sites[::-1], sites + 1e-12]))
    dx, dy = rng.normal(size=(2, 8)) * 20
    forms = packed.pack_forms(rng.normal(size=(300, 8, 8)), inference.dct(4))
    k, top = packed.best(forms, wide, dx, dy, block=50, slice_=70)
    score = np.round(forms @ packed.products(wide.footprints(dx, dy)).T, 9)
    assert np.array_equal(k, score.argmax(1)) and np.allclose(top, score.max(1), atol=1e-8)


def test_saving_makes_rows_once_and_leaves_nothing_when_a_check_fails(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    good = spark.range(10).selectExpr("cast(0 as int) win", "cast(id as double) t", "0.5D p").mapInArrow(run, "win int, t double, p double")
    state.save(good, "motion", f"file://{tmp_path}/m")
    assert made.value == 10 and state.load(spark, "motion", f"file://{tmp_path}/m").count() == 10
    with pytest.raises(ValueError):
        state.save(good.withColumn("t", F.lit(1.0)), "motion", f"file://{tmp_path}/bad")
    with pytest.raises(FileExistsError):
        state.save(good, "motion", f"file://{tmp_path}/m")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["m"]


def test_the_seed_sorts_hardly_more_than_it_takes(spark):
    s = spark.range(20_000).select(F.col("id").alias("spike_id"), F.array(F.col("id").cast("double")).alias("w"))
    got = codebook.smallest_by_hash(s, 300)
    assert [r.spike_id for r in got.collect()] == [r.spike_id for r in s.orderBy(F.xxhash64("spike_id"), "spike_id").limit(300).collect()]
    assert "xxhash64(" in got._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1].split("\n")[0]
    assert codebook.smallest_by_hash(s.limit(50), 300).count() == 50


def test_the_ladder_is_the_profiles_of_each_step(spark):
    s = spark.range(500).selectExpr("cast(id % 7 as double) * 40 t", "cast(id % 90 as double) y", "cast(id % 13 as double) dy", "cast(id % 5 as double) amp")
    got = kept(motion.ladder(s, 100.0, {k: F.col("y") + k * F.col("dy") for k in (0.0, 0.5)}, 10.0), "test")
    assert not got.inputFiles() == s.inputFiles()  # read back from files, not made again
    for k in (0.0, 0.5):
        want = motion.profiles(s.withColumn("yk", F.col("y") + k * F.col("dy")), 100.0, "yk", 10.0)
        assert sorted(map(tuple, got.where(F.col("k") == k).drop("k").collect())) == sorted(map(tuple, want.collect()))
