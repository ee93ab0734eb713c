"""Registered queries of volumes, motion end to end, and blended local axes, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.operators import axes, drift, state, volumes
from tidemark.plans.oracle import GEO, REC
from tidemark.queries import MP, _mp, query
from tidemark.session import shared_dir
from tidemark.sources import recording as R


def _events(spark, sf_dir):
    return _mp(R.spikes(spark, sf_dir)).select("spike_id", "t", "amp", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))


_VOX = f"""{REC}, {GEO}, {MP}, vx AS (SELECT CAST(floor(t / 100) AS BIGINT) AS bin, CAST(floor((mx + 20) / 10) AS BIGINT) AS ix, CAST(floor((my + 20) / 10) AS BIGINT) AS iy, CAST(floor(mz / 20) AS BIGINT) AS iz FROM mp),
    vc AS (SELECT bin, ix, iy, iz, count(*) AS w FROM vx WHERE ix BETWEEN 0 AND 10 AND iy BETWEEN 0 AND 33 AND iz BETWEEN 0 AND 3 GROUP BY ALL)"""


@query(f"""WITH {_VOX}, bs AS (SELECT DISTINCT bin FROM vc),
    de AS (SELECT b.bin, a.i AS ix, y.i AS iy, z.i AS iz, coalesce(w, 0) AS w FROM bs b, range(11) a(i), range(34) y(i), range(4) z(i) LEFT JOIN vc ON vc.bin = b.bin AND vc.ix = a.i AND vc.iy = y.i AND vc.iz = z.i),
    ce AS (SELECT *, w - avg(w) OVER (PARTITION BY bin) AS v FROM de), no AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY bin)) AS u FROM ce),
    r AS (SELECT a.bin AS t, b.bin AS u, lag, sum(a.u * b.u) AS r FROM no b, range(-8, 9) l(lag) JOIN no a ON a.ix = b.ix AND a.iz = b.iz AND a.iy = b.iy + lag AND a.bin > b.bin GROUP BY ALL)
    SELECT t, u, lag * 10.0 AS d, round(r, 5) AS c FROM r QUALIFY row_number() OVER (PARTITION BY t, u ORDER BY round(r, 9) DESC, lag) = 1""")
def volume_pairs(spark, sf_dir):
    """Displacement and correlation of all pairs of volumes of 100 s, lags of 80 um along the probe."""
    g = volumes.grid_for_probe(spark)
    p = volumes.registered(volumes.volumes(_events(spark, sf_dir), g, 100.0), g, (0, 8, 0))
    return p.select("t", "u", "d", F.round("c", 5).alias("c"))


@query()
def volume_pairs_seconds(spark, sf_dir):
    """All pairs of every second one-second volume, smoothed, lags of 80 um: pairs and mean correlations by displacement."""
    g = volumes.grid_for_probe(spark)
    p = volumes.registered(volumes.volumes(_events(spark, sf_dir), g, 1.0, every=2), g, (0, 8, 0), sigma=(0.5, 1.0, 0.0), block=128)
    return p.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 4).alias("c"), F.round(F.avg("soft_c"), 4).alias("soft_c"))


@query()
def volume_pairs_3d(spark, sf_dir):
    """Pairs of volumes of 100 s with lags along all three axes."""
    g = volumes.grid_for_probe(spark)
    p = volumes.registered(volumes.volumes(_events(spark, sf_dir), g, 100.0), g, (2, 8, 1), sigma=(1.0, 1.0, 0.5))
    return p.select("t", "u", "d", "dx", "dz", F.round("c", 5).alias("c"), F.round("soft_d", 3).alias("soft_d"))


@query("""WITH c AS (SELECT CAST((i % 4) * 20 + ((i // 4) % 2) * 10 AS DOUBLE) AS x, CAST((i // 4) * 20 AS DOUBLE) AS y FROM range(64) r(i))
    SELECT min(x) - 20 AS x_lo, min(y) - 20 AS y_lo, CAST(ceil((max(x) - min(x) + 40) / 10) AS BIGINT) AS nx, CAST(ceil((max(y) - min(y) + 40) / 10) AS BIGINT) AS ny, CAST(4 AS BIGINT) AS nz, (SELECT count(*) FROM events) AS spikes FROM c""")
def probe_grid(spark, sf_dir):
    """The grid that the probe asks for, beside the number of spikes it will hold."""
    g = volumes.grid_for_probe(spark)
    n = R.train(spark, sf_dir).agg(F.count(F.lit(1)).alias("spikes"))
    return n.select(F.lit(g.lo[0]).alias("x_lo"), F.lit(g.lo[1]).alias("y_lo"), *[F.lit(g.shape[i]).cast("long").alias(f"n{a}") for i, a in enumerate("xyz")], "spikes")


_CONFIG = drift.Config(time_bin=40.0, windows=3)


@query(f"""WITH {REC}, {GEO}, {MP}, h AS (SELECT CAST(floor(t / 40) AS BIGINT) AS bin, CAST(greatest(0, least(floor(ln(1 + abs(amp)) / 0.75), 7)) AS BIGINT) AS level, CAST(floor(my / 5) AS BIGINT) AS pixel FROM mp WHERE my >= 0 AND my < 320)
    SELECT bin, level * 64 + pixel AS v, CAST(count(*) AS DOUBLE) AS w FROM h GROUP BY ALL""")
def drift_histogram(spark, sf_dir):
    """Spikes by time bin, log amplitude and depth."""
    return drift.histogram(_events(spark, sf_dir), _CONFIG).select("bin", F.explode("cells").alias("c")).select("bin", "c.v", "c.w")


@query()
def drift_motion(spark, sf_dir):
    """Rigid motion and that of three depth windows, checked, saved as the motion table and loaded again: range by window."""
    path = f"{shared_dir(spark)}/tidemark-motion-{uuid.uuid4().hex}"
    state.save(drift.estimated(_events(spark, sf_dir), _CONFIG), "motion", path)
    m = state.load(spark, "motion", path).groupBy("win")
    return m.agg(F.count(F.lit(1)).alias("bins"), F.round(F.max("p") - F.min("p"), 2).alias("range"), F.round(F.avg("p"), 6).alias("mean"))


@query()
def drift_metrics(spark, sf_dir):
    """Depths moved by the recording's zigzag: scores of rigid motion, of the best window, and of events held inside the probe."""
    gt = drift.piecewise(R.WAYPOINTS, F.col("t"))
    e = _events(spark, sf_dir).withColumn("y", F.col("y") * 0.8 + gt)
    m = drift.metrics(e, _CONFIG, gt, bounds=(40.0, 280.0))
    return m.select("kind", "win", *[F.round(c, 3).alias(c) for c in ("r", "gain", "rmse")], "n")


@query()
def blended_axes(spark, sf_dir):
    """Principal scores of the strongest channel's waveform in overlapping depth blocks: mean and spread by depth."""
    s = _mp(R.spikes(spark, sf_dir))
    row = F.slice("w", F.array_position("ptp", F.array_max("ptp")).cast("int") * 8 - 7, 8)
    rows = s.select("spike_id", F.col("my").alias("y"), A.without_dc(row, 1, 8).alias("v"))
    b = axes.blended(rows, "spike_id", "y", "v", axes.Blocks(0.0, 100.0, 100.0, 4), 8, least=200)
    j = b.join(rows.select("spike_id", F.floor(F.col("y") / 40).alias("band")), "spike_id")
    return j.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"s{i}"), 3).alias(f"mean{i}") for i in range(3)], *[F.round(F.stddev_pop(f"s{i}"), 3).alias(f"std{i}") for i in range(3)])
