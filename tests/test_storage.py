"""Raw recordings, snapshot tables and stream-stream joins."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.snapshots import Table, fed
from tidemark.sources import raw
from tidemark.streaming.joins import interval_pairs


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    """A recording of 4 channels and 5,000 samples in files of 700, and its samples."""
    rng = np.random.default_rng(0)
    x = np.rint(np.cumsum(rng.normal(size=(5000, 4)), 0) * 20 + rng.normal(size=(5000, 4)) * 300).astype("<i2")
    path = tmp_path_factory.mktemp("raw")
    for s in range(0, 5000, 700):
        (path / f"chunk-{s:05d}.bin").write_bytes(x[s : s + 700].tobytes())
    raw.register(spark)
    return str(path), x


def read(spark, path, **options):
    r = spark.read.format("tidemark_raw").options(path=path, channels=4, rate=3000, cutoff=300, **options).load()
    rows = r.orderBy("sample").collect()
    assert [row["sample"] for row in rows] == list(range(len(rows)))
    return np.array([row["v"] for row in rows])


def test_raw_samples(spark, recorded):
    path, x = recorded
    for window in (1, 999, 5000, 10_000):
        if window > 1:
            assert (read(spark, path, window=window, filter="false", reference="false") == x).all()
    assert np.allclose(read(spark, path, window=1300, filter="false"), x - np.median(x, axis=1, keepdims=True))
    assert (read(spark, f"file://{path}", window=5000, filter="false", reference="false") == x).all()


def test_any_split_gives_the_same_samples(spark, recorded):
    path, _ = recorded
    whole = read(spark, path, window=5000)
    for window in (313, 1700):
        assert np.allclose(read(spark, path, window=window, pad=300), whole, atol=1e-2)


def test_the_filter_is_a_zero_phase_high_pass():
    t = np.arange(6000) / 30_000
    slow, fast = np.sin(2 * np.pi * 20 * t)[:, None], np.sin(2 * np.pi * 3000 * t)[:, None]
    assert np.abs(raw.zero_phase(slow, 30_000, 300))[300:-300].max() < 0.01
    assert np.abs(raw.zero_phase(fast, 30_000, 300) - fast)[300:-300].max() < 0.01
    assert np.abs(raw.zero_phase(np.full((500, 2), 7.0), 30_000, 300)).max() < 1e-9
    # third order: at the cutoff each pass takes off 3 dB, below it 18 dB an octave
    w = np.exp(-2j * np.pi * np.array([300, 75, 37.5]) / 30_000)
    gain = np.abs(np.prod([sum(c * w**k for k, c in enumerate(b)) / sum(c * w**k for k, c in enumerate(a)) for b, a in raw.high_pass(30_000, 300)], axis=0))
    assert abs(gain[0] - np.sqrt(0.5)) < 1e-9 and abs(20 * np.log10(gain[1] / gain[2]) - 18.06) < 0.2


def test_written_recordings(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(-5, 2005)), int(rng.integers(-1, 4)), float(rng.integers(-400, 400))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "sample long, channel int, value double")
    done = raw.written(df, f"{tmp_path}/a", 3, 2000, 333).orderBy("start").collect()
    assert sum(r.samples for r in done) == 2000 and [r.start for r in done] == list(range(0, 2000, 333)) and all(r.bytes == 6 * r.samples for r in done)
    want = np.zeros((2000, 3))
    for s, c, v in rows:
        if 0 <= s < 2000 and 0 <= c < 3:
            want[s, c] += v
    raw.register(spark)
    got = spark.read.format("tidemark_raw").options(path=f"{tmp_path}/a", channels=3, window=512, filter="false", reference="false").load().orderBy("sample").collect()
    assert (np.array([r.v for r in got]) == np.rint(want)).all()


def test_raw_errors(recorded, tmp_path):
    path, _ = recorded
    for options, text in [({"path": path, "channels": "3"}, "whole samples"), ({}, "path"), ({"path": path, "channels": "4", "cutoff": "9e9"}, "cutoff")]:
        with pytest.raises(ValueError, match=text):
            raw.Reader(options)
    with pytest.raises(FileNotFoundError):
        raw.Reader({"path": f"{tmp_path}/none", "channels": "4"})
    (tmp_path / "empty.bin").write_bytes(b"")
    assert list(raw.Reader({"path": f"{tmp_path}/empty.bin", "channels": "4"}).read(raw.Window(0, 0))) == []


# snapshots


def test_snapshots_keep_versions(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], "v")
    assert t.newest() is None and t.read() is None
    t.upsert(spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", 5)], "k long, v int, x string, y int"))
    t.upsert(spark.createDataFrame([(2, 3, None, 7), (3, 1, "c", None)], "k long, v int, x string, y int"))
    assert sorted(map(tuple, t.read().select("k", "v", "x", "y").collect())) == [(1, 1, "a", None), (2, 3, "b", 7), (3, 1, "c", None)]
    assert sorted(map(tuple, t.read(0).select("k", "x").collect())) == [(1, "a"), (2, "b")]
    # an older change fills what is null or new, and replaces nothing
    t.upsert(spark.createDataFrame([(2, 2, "old", 1.5)], "k long, v int, x string, z double"))
    assert tuple(t.read().where("k = 2").select("v", "x", "y", "z").first()) == (3, "b", 7, 1.5)
    t.kept(1)
    assert t.newest().number == 2 and t.read().count() == 3
    with pytest.raises(Exception):
        t.version(0)


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failed = f"file://{tmp_path}/t", []

    def write(name, k):
        try:
            t = Table(spark, path, ["k"], "v")
            for i in range(3):
                t.upsert(spark.createDataFrame([(0, i, 10 * i + k), (k, i, i)], f"k long, v int, {name} int"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(f"f{k}", k)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    t = Table(spark, path, ["k"], "v")
    assert t.newest().number == 5 and tuple(t.read().where("k = 0").select("v", "f1", "f2").first()) == (2, 21, 22) and t.read().count() == 3


def test_a_batch_is_applied_once(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], "v")
    change = spark.createDataFrame([(1, 1, 5)], "k long, v int, x int")
    first = t.upsert(change, "stream", 4)
    assert t.upsert(change, "stream", 4) == first and t.upsert(change, "stream", 3) == first and t.newest().number == 0
    assert t.upsert(change, "other", 4).number == 1
    spark.range(30).selectExpr("id % 7 as k", "cast(id as int) as v", "cast(id * 2 as int) as x").repartition(3).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("k long, v int, x int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = Table(spark, f"file://{tmp_path}/fed", ["k"], "v")
    for _ in range(2):
        fed(feed, out, "feed", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, out.read().select("k", "v", "x").collect())) == sorted((k, v, 2 * v) for k in range(7) for v in [max(i for i in range(30) if i % 7 == k)])
    assert out.newest().applied["feed"] == out.newest().number == 2


# stream-stream joins


def test_interval_pairs_equal_the_batch_join(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, float(t)) for i, t in enumerate(np.sort(rng.random(400)) * 4000)]
    df = spark.createDataFrame(rows, "id long, s double").select("id", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"), (F.col("id") % 3).alias("g"))
    for i in range(8):
        df.where(f"id div 50 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    names = " ".join(f"{tmp_path}/in{i}" for i in range(8)).split()
    merged = f"{tmp_path}/all"
    for n in names:
        spark.read.parquet(n).coalesce(1).write.mode("append").parquet(merged)
    for key in (None, "g"):
        feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(merged)
        pairs = interval_pairs(feed.where("id % 2 = 0"), feed.where("id % 2 = 1"), "20 seconds", "30 seconds", key, bucket=25)
        out = f"{tmp_path}/out-{key}"
        q = pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(out).select("l_id", "r_id").collect()))
        want = sorted((a, b) for a, s in rows for b, t in rows if a % 2 == 0 and b % 2 == 1 and abs(int(s * 1000) - int(t * 1000)) <= 20_000 and (key is None or a % 3 == b % 3))
        assert got == want and len(want) > 30
        # 4,000 s of rows went by; what is left is what the last watermark may still need
        states = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
        assert states[-1] < 200 < 4 * 400
