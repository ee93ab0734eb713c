"""Saved fits, .npy recordings, the run index and the tables behind views."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, refine, runs, views
from tidemark.operators.candidates import Candidates, grid
from tidemark.sources import arrays, fits
from tidemark.sources import recording as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    fit = fits.Fit(Candidates(grid(2, 2, 2), [("gauss", 60.0, 2.0), ("power", 30.0, 1.5)]), inference.dct(3))
    fit.assignments = fits.assigned(R.spikes(spark, SF), fit).persist()
    return fit


def test_a_fit_is_saved_once_and_loaded_whole(spark, small, tmp_path):
    path = f"file://{tmp_path}/a"
    assert not fits.complete(spark, path)
    assert fits.save(spark, path, small, {"M": "3"}, [{"step": 0, "nmse": 0.5}]) and fits.complete(spark, path)
    assert not fits.save(spark, path, small, {"M": "9"})
    back = fits.load(spark, path)
    assert np.allclose(back.candidates.sites, small.candidates.sites) and back.candidates.profiles == small.candidates.profiles and np.allclose(back.omega, small.omega)
    assert back.summary["config"] == {"M": "3"} and back.summary["spikes"] == 1000 and back.summary["KS"] == 16
    assert back.assignments.exceptAll(small.assignments).count() == 0
    own, again = small.footprints(spark), back.footprints(spark)
    assert all(np.allclose(own[c], again[c]) for c in own) and np.allclose(np.linalg.norm(again[5], axis=0), 1)
    # what the assignment captured is what its footprints capture
    r = back.assignments.join(R.spikes(spark, SF).select("spike_id", "w"), "spike_id").first()
    y = np.array(r.w).reshape(8, 8)
    y = y - y.mean(1, keepdims=True)
    left = y - np.outer(again[r.channel][:, r.k], np.array(r.coef) @ small.omega)
    assert abs((left**2).sum() - r.sse) < 1e-4 * (1 + r.sse)


def test_the_other_family(spark, tmp_path):
    fit = fits.Fit(refine.Learned(grid(2, 2, 2), np.linspace(10, 40, 8)), inference.dct(2))
    fit.assignments = fits.assigned(R.spikes(spark, SF), fit)
    assert fits.save(spark, f"file://{tmp_path}/b", fit, {})
    back = fits.load(spark, f"file://{tmp_path}/b")
    assert isinstance(back.candidates, refine.Learned) and np.allclose(back.candidates.widths, fit.candidates.widths) and back.summary["learned"]


def test_broken_fits_are_errors(spark, small, tmp_path):
    with pytest.raises(FileNotFoundError, match="summary"):
        fits.load(spark, f"file://{tmp_path}/none")
    bad = fits.Fit(small.candidates, small.omega, small.assignments.withColumn("k", F.when(F.col("spike_id") < 3, 99).otherwise(F.col("k"))))
    with pytest.raises(ValueError, match="candidate in the codebook.*3"):
        fits.save(spark, f"file://{tmp_path}/bad", bad, {})
    fits.save(spark, f"file://{tmp_path}/c", small, {})
    book = tmp_path / "c" / "codebook.json"
    changed = json.loads(book.read_text())
    changed["omega"][0][0] += 1e-9
    book.write_text(json.dumps(changed))
    (tmp_path / "c" / ".codebook.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="isn't the one"):
        fits.load(spark, f"file://{tmp_path}/c")


def test_rescaling_and_places(spark):
    a = spark.createDataFrame([(0, 5, 0, 3.0, None), (1, 5, 1, 5.0, 7.0), (2, 6, 0, 40.0, None)], "spike_id long, channel int, k long, amp double, px double")
    got = {r.spike_id: r.amp for r in fits.rescaled(a).collect()}
    assert got[1] == 100 and abs(got[2] / got[0] - 40 / 3) < 1e-12
    with pytest.raises(ValueError, match="amplitude median"):
        fits.rescaled(a.withColumn("amp", F.lit(0.0)))
    with pytest.raises(ValueError, match="amplitude median"):
        fits.rescaled(a.limit(0))
    c = {r.channel: (r.x, r.y) for r in R.channels(spark).collect()}
    fit = fits.Fit(refine.Learned(np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), np.ones(2)), inference.dct(2))
    rows = {r.spike_id: (r.x, r.y, r.z) for r in fits.placed(a, fit).collect()}
    assert rows[0] == (1, 2, 3) and rows[1] == (7.0 - c[5][0], 5, 6)  # an explicit place wins, where there is one


def test_npy_arrays(spark, tmp_path):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(5000, 10, 90)).astype(np.float16)
    np.save(tmp_path / "waveforms.npy", w)
    np.save(tmp_path / "spike_times.npy", np.arange(5000, dtype=np.uint64) * 7)
    np.save(tmp_path / "spike_channels.npy", rng.integers(0, 384, 5000).astype(np.int16))
    r = arrays.recording(spark, str(tmp_path), "np1")
    assert r.count() == 5000 and r.columns == ["spike_id", "sample", "t", "channel", "w"]
    row = r.where("spike_id = 4321").first()
    assert row["sample"] == 4321 * 7 and abs(row.t - 4321 * 7 / 30_000) < 1e-12 and np.allclose(row.w, w[4321].ravel().astype(float))
    assert r.agg(F.sum("sample")).first()[0] == sum(range(5000)) * 7
    with pytest.raises(ValueError, match="waveforms"):
        arrays.recording(spark, str(tmp_path), "derived")
    np.save(tmp_path / "short.npy", np.arange(3))
    with pytest.raises(ValueError, match="different lengths"):
        arrays.rows(spark, {"a": (f"{tmp_path}/short.npy", "long"), "b": (f"{tmp_path}/spike_times.npy", "long")})
    with pytest.raises(ValueError, match="one value"):
        arrays.rows(spark, {"a": (f"{tmp_path}/waveforms.npy", "double")})
    np.save(tmp_path / "f.npy", np.asfortranarray(rng.normal(size=(4, 3))))
    with pytest.raises(ValueError, match="column-major"):
        arrays.header(f"{tmp_path}/f.npy")
    np.save(tmp_path / "none.npy", np.empty((0, 3)))
    assert arrays.rows(spark, {"a": (f"{tmp_path}/none.npy", "array<double>")}).count() == 0
    with pytest.raises(KeyError, match="np1"):
        arrays.dataset("np9")
    with pytest.raises(ValueError):
        arrays.registered(arrays.Dataset("x", 0.0, 1, 1, 1.0))


def test_run_index(spark, tmp_path):
    for name, s, h in [("a", {"K": 27, "KS": 27, "Q": 4, "sse": 5.0, "learned": False, "config": {"kernel": "gauss"}}, ['{"step": 0, "nmse": 0.5}', '{"iteration": 1, "objective": 0.25, "wall_s": 3}', "not json", '{"k": 2, "loss": 0.3}']), ("b", {"K": 8, "KS": 16}, []), ("c", None, ['{"step": 0, "nmse": 1}'])]:
        d = tmp_path / name
        d.mkdir()
        if s:
            (d / "summary.json").write_text(json.dumps(s))
        (d / "history.jsonl").write_text("\n".join(h))
    i = runs.index(spark, str(tmp_path), spark.createDataFrame([("a", 0.9), ("z", 0.1)], "run string, r double"))
    rows = {r.run: r for r in i.collect()}
    assert set(rows) == {"a", "b"} and rows["b"].sse is None and rows["a"].r == 0.9 and rows["a"].config["kernel"] == "gauss"
    a = rows["a"]
    assert (a.steps, a["first"], a["last"], a.least, a["at"], a.rose) == (3, 0.5, 0.3, 0.25, 1, True)
    assert [r.run for r in runs.ordered(i, "sse").collect()] == ["a", "b"] == [r.run for r in runs.ordered(i, "sse", True).collect()]
    assert [r.run for r in runs.filtered(i, {"K": 8}).collect()] == ["b"] and [r.run for r in runs.filtered(i, {"sse": None}).collect()] == ["b"]
    assert [r.run for r in runs.filtered(i, present=["r"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="none"):
        runs.filtered(i, {"none": 1})


def test_views(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i * 7 % 20), float(i % 5)) for i in range(100)], "spike_id long, q int, y double, x double")
    placed = views.grouped_rank(rows, "q", ["spike_id"]).orderBy("at").collect()
    assert [(r.q, r.spike_id) for r in placed] == sorted((i % 3, i) for i in range(100)) and [r["at"] for r in placed] == list(range(100))
    some = views.capped(rows, "q", "spike_id", 5)
    assert {r.q: r["count"] for r in some.groupBy("q").count().collect()} == {0: 5, 1: 5, 2: 5}
    assert sorted(r.spike_id for r in some.collect()) == sorted(r.spike_id for r in views.capped(rows.repartition(9), "q", "spike_id", 5).collect())
    q = spark.createDataFrame([(None,), (-1.0,), (0.0,), (5.0,), (10.0,), (99.0,)], "v double").select(views.quantised(F.col("v"), 0.0, 10.0).alias("q")).collect()
    assert [r.q for r in q] == [None, 0, 0, 32768, 65535, 65535]
    b = views.packed_column(rows.withColumn("v", F.col("spike_id").cast("int") * 600), "q", "spike_id", "v").collect()
    for r in b:
        assert np.frombuffer(base64.b64decode(r.data.replace("\r\n", "")), "<u2").tolist() == [600 * i for i in range(100) if i % 3 == r.q]
    assert 20 <= views.in_view(rows, most=50).count() <= 80 and views.in_view(rows, (3.0, 6.0)).count() == rows.where("y between 3 and 6").count()
    assert views.nearest_row(rows, 0.2, 0.1).first().spike_id == 0 and views.nearest_row(rows, 500.0, 0.0, within=3.0).count() == 0
    chosen = views.examples(spark, "[5, 2, 9]", rows, 2)
    assert [r.spike_id for r in views.covered(chosen, rows).orderBy("place").collect()] == [5, 2, 9]
    assert views.examples(spark, None, rows, 4).count() == 4
    with pytest.raises(ValueError, match="777"):
        views.covered(views.examples(spark, "[5, 777]", rows, 2), rows)
    payload = views.atom_payload(rows, 4, {"y": (0.0, 20.0)})
    assert payload.count() == 12 and payload.columns == ["q", "spike_id", "y"]


def test_fields_and_scales(spark):
    s = spark.createDataFrame([(1, 30.0, 100.0, 12.0), (2, 10.0, 0.0, 4.0)], "spike_id long, px double, py double, pz double")
    got = views.field(spark, s, "gauss", 25.0, most=60.0).collect()
    c = {r.channel: (r.x, r.y) for r in R.channels(spark).collect()}
    for i, (x, y, z) in {1: (30, 100, 12), 2: (10, 0, 4)}.items():
        want = {k: np.exp(-((a - x) ** 2 + (b - y) ** 2 + z * z) / 1250) for k, (a, b) in c.items() if abs(b - y) <= 60}
        size = np.sqrt(sum(v * v for v in want.values()))
        assert {r.channel: round(r.g, 12) for r in got if r.spike_id == i} == {k: round(v / size, 12) for k, v in want.items()}
    g = views.soft_footprint(np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]), np.eye(4)[:, :3])
    assert np.allclose(g, [[np.sqrt(0.5)] * 2 + [0, 0], [0, 0, 1, 0]])
    r = spark.range(1).select(views.linspace(0.0, 1.0, 5).alias("a"), views.geomspace(1.0, 16.0, 5).alias("b"), views.linspace(2.0, 9.0, 1).alias("c"), views.above_floor(F.array(*[F.lit(float(x)) for x in (1, 9, 4, 6)])).alias("d")).first()
    assert r.a == [0, 0.25, 0.5, 0.75, 1] and np.allclose(r.b, [1, 2, 4, 8, 16]) and r.c == [2] and r.d == [0, 4, 0, 1]
    j = [x[0] for x in spark.range(500).select(views.jitter(F.col("id"), 3, 4.0)).collect()]
    assert -2 <= min(j) < -1.5 and 1.5 < max(j) < 2 and j == [x[0] for x in spark.range(500).repartition(5).select("id", views.jitter(F.col("id"), 3, 4.0).alias("j")).orderBy("id").select("j").collect()]


def test_tree_fingerprint(spark):
    rows = spark.range(5000).selectExpr("id as spike_id", "id * 3 as v")
    one = views.tree_fingerprint(rows, "spike_id", fan=50)
    assert len(one) == 64 and one == views.tree_fingerprint(rows.repartition(7), "spike_id", fan=50)
    assert one != views.tree_fingerprint(rows.withColumn("v", F.when(F.col("spike_id") == 77, 0).otherwise(F.col("v"))), "spike_id", fan=50)
    assert views.tree_fingerprint(rows.limit(0), "spike_id") == ""
