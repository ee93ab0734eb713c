"""Registered queries over the synthetic recording, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions.kernels import KERNELS
from tidemark.operators import inference, interpolate, learning, motion, rasters, tables, windows
from tidemark.plans.oracle import GEO, LAT, REC, WAY
from tidemark.sources import recording as R
from tidemark.session import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r4(c) -> F.Column:
    return F.round(c, 4)


def _mp(spikes: DataFrame) -> DataFrame:
    """Spikes with the centroid of their neighbours by peak-to-peak (mx, my), mz, and geometry; the 64 channels are broadcast."""
    g = R.geometry(spikes.sparkSession)
    j = spikes.join(F.broadcast(g), "channel").withColumn("ptp", A.peak_to_peak(F.col("w"), 8, 8))
    share = F.when(A.total(F.col("ptp")) > 0, A.total(F.col("ptp")))  # a silent spike lies at its own contact
    return j.withColumns({"mx": F.col("x") + F.coalesce(A.dot(F.col("ptp"), F.col("dx")) / share, F.lit(0.0)), "my": F.col("y") + F.coalesce(A.dot(F.col("ptp"), F.col("dy")) / share, F.lit(0.0)), "mz": 5 + F.col("amp") / 10})


MP = """mp AS (SELECT z.*, geo.* EXCLUDE channel, x + CASE WHEN list_sum(ptp) > 0 THEN list_sum(list_transform(range(1, 9), lambda i: ptp[i] * dx[i])) / list_sum(ptp) ELSE 0 END AS mx,
        y + CASE WHEN list_sum(ptp) > 0 THEN list_sum(list_transform(range(1, 9), lambda i: ptp[i] * dy[i])) / list_sum(ptp) ELSE 0 END AS my, 5 + amp / 10 AS mz FROM z JOIN geo USING (channel))"""
SHARES = "CASE WHEN list_sum(ptp) > 0 THEN list_transform(ptp, lambda x: x / list_sum(ptp)) ELSE [1.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0] END"


# scans, geometry, kernels


@query(f"WITH {REC} SELECT channel, count(*) AS n, round(sum(list_sum(list_transform(zw, lambda v: v * v))), 4) AS energy, round(max(list_max(ptp)), 4) AS ptp FROM z GROUP BY channel")
def scan_dc_energy(spark, sf_dir):
    s = R.spikes(spark, sf_dir)
    z = A.without_dc(F.col("w"), 8, 8)
    ptp = F.array_max(A.peak_to_peak(F.col("w"), 8, 8))
    return s.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), r4(F.sum(A.energy(z))).alias("energy"), r4(F.max(ptp)).alias("ptp"))


@query(f"WITH {REC}, {GEO} SELECT nb.channel, slot, nbr, dx, dy, count(spike_id) AS n FROM nb LEFT JOIN train t ON t.channel = nb.nbr GROUP BY ALL")
def channel_neighbors(spark, sf_dir):
    used = R.train(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("channel", "nbr")
    return R.neighbors(spark).join(used, "nbr", "left").na.fill(0, ["n"]).select("channel", F.col("slot").cast("long").alias("slot"), "nbr", "dx", "dy", "n")


@query(f"WITH {REC}, {GEO} SELECT cfg, count(DISTINCT geo.channel) AS channels, count(*) AS n, round(sum(amp), 4) AS amp FROM train JOIN geo USING (channel) GROUP BY cfg")
def channel_configs(spark, sf_dir):
    g = R.geometry(spark).select("channel", "cfg")
    s = R.train(spark, sf_dir).join(F.broadcast(g), "channel")
    return s.groupBy(F.col("cfg").cast("long").alias("cfg")).agg(F.countDistinct("channel").alias("channels"), F.count(F.lit(1)).alias("n"), r4(F.sum("amp")).alias("amp"))


_KERNEL_SQL = {
    "monopole": "a / sqrt(r2 + z2 + a * a)",
    "gauss": "exp(-(r2 + z2) / (2 * a * a))",
    "exp": "exp(-sqrt(r2 + z2) / a)",
    "lorentz": "a * a / (r2 + z2 + a * a)",
    "power": "pow(a / sqrt(r2 + z2 + a * a), b)",
    "student": "pow(1 + (r2 + z2) / (a * a), -b)",
    "yukawa": "a / sqrt(r2 + z2 + a * a) * exp(-sqrt(r2 + z2 + 1e-6) / b)",
    "gauss_aniso": "exp(-(r2 / (2 * a * a) + z2 / (2 * b * b)))",
    "mono_aniso": "a / sqrt(r2 + z2 * pow(a / b, 2) + a * a)",
    "dog": "exp(-(r2 + z2) / (2 * a * a)) - exp(-(r2 + z2) / (2 * pow(a * b, 2))) / (b * b)",
}


def _kernel_query(name: str) -> None:
    def run(spark, sf_dir):
        s = _mp(R.spikes(spark, sf_dir))
        k = KERNELS[name]
        g = F.zip_with("dx", "dy", lambda dx, dy: k(F.pow(F.col("x") + dx - F.col("mx"), 2) + F.pow(F.col("y") + dy - F.col("my"), 2), F.col("mz") * F.col("mz"), 15.0, 2.0))
        return s.select("channel", g.alias("g")).groupBy("channel").agg(r4(F.sum(A.total(F.col("g")))).alias("field"), r4(F.sum(A.energy(F.col("g")))).alias("norm2"))

    run.__name__ = f"kernel_{name}"
    query(f"""WITH {REC}, {GEO}, {MP},
        d AS (SELECT channel, unnest(list_transform(range(1, 9), lambda i: pow(x + dx[i] - mx, 2) + pow(y + dy[i] - my, 2))) AS r2, mz * mz AS z2, 15.0::DOUBLE AS a, 2.0::DOUBLE AS b FROM mp),
        k AS (SELECT channel, {_KERNEL_SQL[name]} AS g FROM d) SELECT channel, round(sum(g), 4) AS field, round(sum(g * g), 4) AS norm2 FROM k GROUP BY channel""")(run)


for _name in KERNELS:
    _kernel_query(_name)


@query(f"WITH {REC}, {GEO}, {LAT} SELECT cfg, n, round(sum(g[1] * amp), 4) AS g0, count(*) AS spikes FROM train JOIN fp ON train.channel = fp.channel GROUP BY cfg, n")
def footprints_unit(spark, sf_dir):
    f = inference.footprints(spark).select("channel", F.col("cfg").cast("long").alias("cfg"), F.explode("cand").alias("c"))
    used = R.train(spark, sf_dir).groupBy("channel").agg(F.sum("amp").alias("amp"), F.count(F.lit(1)).alias("m"))
    return f.join(used, "channel").groupBy("cfg", F.col("c.n").cast("long").alias("n")).agg(r4(F.sum(F.element_at("c.g", 1) * F.col("amp"))).alias("g0"), F.sum("m").alias("spikes"))


@query(f"""WITH {REC}, s AS (SELECT kind, unnest(range(-2, 3)) AS lag, w[1:8] AS v FROM sp),
    b AS (SELECT kind, lag, list_transform(range(1, 9), lambda i: CASE WHEN i - lag BETWEEN 1 AND 8 THEN v[i - lag] ELSE 0 END) AS v FROM s)
    SELECT kind, lag, round(sum(sqrt(list_sum(list_transform(v, lambda x: x * x)))), 4) AS norm, round(sum(v[1]), 4) AS head FROM b GROUP BY ALL""")
def shift_bank(spark, sf_dir):
    """Every spike's first row at five lags, zero-padded."""
    s = R.spikes(spark, sf_dir).select("kind", F.slice("w", 1, 8).alias("v"))
    lags = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), A.shifted(F.col("v"), k, 8).alias("v")) for k in range(-2, 3)])
    b = s.select("kind", F.inline(lags))
    return b.groupBy("kind", "lag").agg(r4(F.sum(F.sqrt(A.energy(F.col("v"))))).alias("norm"), r4(F.sum(F.element_at("v", 1))).alias("head"))


# inference


@query(f"WITH {REC}, {GEO}, {LAT} SELECT spike_id, n, round(score, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY round(score, 9) DESC, n) <= 3")
def topk_single(spark, sf_dir):
    a = inference.assigned(R.spikes(spark, sf_dir), k=3)
    return a.select("spike_id", F.inline("top")).select("spike_id", "n", r4(F.col("score")).alias("score"))


@query(f"WITH {REC}, {GEO}, {LAT} SELECT n, pz, count(*) AS spikes, round(sum(score), 4) AS captured, round(1 - sum(score) / nullif(sum(energy), 0), 4) AS nmse FROM loc GROUP BY n, pz")
def assign_one_source(spark, sf_dir):
    a = inference.located(R.spikes(spark, sf_dir))
    return a.groupBy("n", "pz").agg(F.count(F.lit(1)).alias("spikes"), r4(F.sum("score")).alias("captured"), r4(1 - F.try_divide(F.sum("score"), F.sum("energy"))).alias("nmse"))


@query(f"WITH {REC}, {GEO}, {LAT} SELECT channel, round(sum(energy - score), 4) AS sse, round(sum(energy), 4) AS energy, round(sum(score) / nullif(sum(energy), 0), 4) AS ve FROM loc GROUP BY channel")
def residual_nmse_ve(spark, sf_dir):
    p = inference.located(R.spikes(spark, sf_dir))
    return p.groupBy("channel").agg(r4(F.sum(F.col("energy") - F.col("score"))).alias("sse"), r4(F.sum("energy")).alias("energy"), r4(F.try_divide(F.sum("score"), F.sum("energy"))).alias("ve"))


@query(f"WITH {REC}, {GEO}, {LAT} SELECT CAST(floor(t / 20) AS INT) AS tbin, CAST(floor(py / 20) AS INT) AS ybin, round(sum(sqrt(score)), 4) AS amp, count(*) AS n FROM loc WHERE py BETWEEN 0 AND 320 GROUP BY ALL")
def localize_raster(spark, sf_dir):
    """Flagship: place every spike, then its amplitude by time and depth."""
    p = inference.located(R.spikes(spark, sf_dir)).where("py between 0 and 320")
    r = rasters.raster(p, {"tbin": F.floor(F.col("t") / 20).cast("int"), "ybin": F.floor(F.col("py") / 20).cast("int")}, amp=F.sqrt("score"))
    return r.withColumn("amp", r4(F.col("amp")))


@query()
def matching_pursuit(spark, sf_dir):
    s = inference.sources(R.spikes(spark, sf_dir))
    return s.select("spike_id", "rank", "n", "q", "lag", r4(F.col("amp")).alias("amp"), r4(F.col("captured")).alias("captured"), r4(F.col("energy")).alias("energy"))


@query()
def source_usage(spark, sf_dir):
    """Contribution of each place and shape over all sources of the pursuit."""
    s = inference.sources(R.spikes(spark, sf_dir))
    return s.groupBy("n", "q").agg(F.count(F.lit(1)).alias("sources"), r4(F.sum("amp")).alias("amp"))


@query(f"""WITH {REC}, {GEO}, {LAT}, t2 AS (SELECT spike_id, n, score, row_number() OVER (PARTITION BY spike_id ORDER BY round(score, 9) DESC, n) AS rn FROM sc QUALIFY rn <= 2),
    uu AS (SELECT t2.spike_id, rn, t2.n, score, m, any_value(g) AS g, any_value(list_sum(list_transform(range(1, 9), lambda c: g[c] * p[c]))) AS u FROM t2 JOIN pj USING (spike_id) JOIN fp ON fp.channel = pj.channel AND fp.n = t2.n GROUP BY ALL),
    pr AS (SELECT a.spike_id, any_value(a.n) AS n1, any_value(b.n) AS n2, any_value(a.score) AS s1, any_value(b.score) AS s2, any_value(list_sum(list_transform(range(1, 9), lambda i: a.g[i] * b.g[i]))) AS c, sum(a.u * b.u) AS x FROM uu a JOIN uu b ON a.spike_id = b.spike_id AND a.m = b.m AND a.rn = 1 AND b.rn = 2 GROUP BY a.spike_id),
    r AS (SELECT *, (s1 + s2 - 2 * c * x) / greatest(1 - c * c, 1e-12) AS captured FROM pr)
    SELECT n1, n2, count(*) AS n, round(avg(captured - s2), 3) AS loss1, round(avg(captured - s1), 3) AS loss2, round(avg((1 + abs(c)) / greatest(1 - abs(c), 1e-12)), 3) AS condition FROM r GROUP BY n1, n2""")
def pair_multishape_2x2(spark, sf_dir):
    """Two-source refit by pair of places: what leaving either out loses, and the condition of the pair."""
    p = inference.pair_terms(R.spikes(spark, sf_dir))
    g = p.groupBy(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("captured") - F.col("s2")), 3).alias("loss1"), F.round(F.avg(F.col("captured") - F.col("s1")), 3).alias("loss2"), F.round(F.avg("condition"), 3).alias("condition"))


@query()
def pair_multishape_search(spark, sf_dir):
    """As pair_multishape_2x2, with the best of all pairs of places for each spike."""
    p = inference.pair_search(R.spikes(spark, sf_dir))
    g = p.groupBy(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("captured") - F.col("s2")), 3).alias("loss1"), F.round(F.avg(F.col("captured") - F.col("s1")), 3).alias("loss2"), F.round(F.avg("condition"), 3).alias("condition"))


# readouts, rasters, aggregations


@query(f"WITH {REC}, h AS (SELECT {SHARES} AS h FROM z), s AS (SELECT list_reverse_sort(h)[2] AS second, list_sum(list_transform(h, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)) AS entropy FROM h) SELECT CAST(least(floor(second * 20), 9) AS INT) AS bin, count(*) AS n, round(avg(entropy), 4) AS entropy FROM s GROUP BY 1")
def second_contribution(spark, sf_dir):
    """Histogram of the second-largest slot share, with the mean entropy of the shares."""
    s = R.spikes(spark, sf_dir).select(A.shares(A.peak_to_peak(F.col("w"), 8, 8)).alias("share"))
    entropy = F.aggregate("share", F.lit(0.0), lambda t, x: t - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    s = s.select(F.element_at(F.sort_array("share", False), 2).alias("second"), entropy.alias("entropy"))
    return s.groupBy(F.least(F.floor(F.col("second") * 20), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), r4(F.avg("entropy")).alias("entropy"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_tags(spark, sf_dir):
    """Keys of one table that another lacks."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


@query(f"WITH {REC} SELECT 'run' AS row_kind, kind AS name, count(*) AS n, round(sum(amp), 3) AS amp, 0 AS users FROM train GROUP BY kind UNION ALL SELECT 'control', 'ch' || CAST(channel AS VARCHAR), count(*), NULL, count(DISTINCT user_id) FROM train GROUP BY channel")
def union_index_rows(spark, sf_dir):
    """Rows of two kinds with different fields in one table."""
    s = R.train(spark, sf_dir)
    a = s.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amp"), 3).alias("amp")).withColumn("row_kind", F.lit("run"))
    b = s.groupBy(F.concat(F.lit("ch"), F.col("channel").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).withColumn("row_kind", F.lit("control"))
    return a.unionByName(b, allowMissingColumns=True).na.fill(0, ["users"]).select("row_kind", "name", "n", "amp", "users")


@query(f"WITH {REC} SELECT spike_id, channel, kind FROM train ORDER BY (spike_id * 7919 + 104729) % 1000003, spike_id LIMIT 500")
def seeded_sample(spark, sf_dir):
    """500 spikes in the order of a portable hash: the sampling operator."""
    h = (F.col("spike_id") * 7919 + 104729) % 1000003
    return R.train(spark, sf_dir).select("spike_id", "channel", "kind").orderBy(h, "spike_id").limit(500)


@query(f"WITH {REC}, {GEO}, h AS (SELECT spike_id, channel, {SHARES} AS h FROM z) SELECT spike_id, r.slot - 1 AS slot, nbr, round(h[r.slot], 4) AS weight FROM h, range(1, 9) r(slot) JOIN nb ON nb.slot = r.slot - 1 WHERE nb.channel = h.channel AND h[r.slot] > 0")
def flatten_sources(spark, sf_dir):
    """One row for each active slot of each spike; of a silent spike the first slot is active."""
    s = R.spikes(spark, sf_dir).select("spike_id", "channel", A.shares(A.peak_to_peak(F.col("w"), 8, 8)).alias("share"))
    e = s.select("spike_id", "channel", F.posexplode("share").alias("slot", "p")).where("p > 0")
    return e.join(F.broadcast(R.neighbors(spark).select("channel", "slot", "nbr")), ["channel", "slot"]).select("spike_id", F.col("slot").cast("long").alias("slot"), "nbr", r4("p").alias("weight"))


@query(f"WITH {REC}, {GEO}, {MP} SELECT spike_id, round(mx, 4) AS mx, round(my, 4) AS my, nbr AS dominant FROM mp JOIN nb ON nb.channel = mp.channel AND nb.slot = list_position(ptp, list_max(ptp)) - 1")
def readout_barycenter(spark, sf_dir):
    """Amplitude-weighted centre and dominant neighbour (ties to the smaller slot)."""
    s = _mp(R.spikes(spark, sf_dir)).select("spike_id", "channel", "mx", "my", (F.array_position("ptp", F.array_max("ptp")) - 1).cast("int").alias("slot"))
    return s.join(F.broadcast(R.neighbors(spark).select("channel", "slot", "nbr")), ["channel", "slot"]).select("spike_id", r4(F.col("mx")).alias("mx"), r4(F.col("my")).alias("my"), F.col("nbr").alias("dominant"))


@query(f"WITH {REC}, {GEO} SELECT count(*) AS n, min(spike_id) AS first, max(spike_id) AS last, round(sum(amp), 4) AS amp, y FROM train JOIN ch USING (channel) WHERE y BETWEEN 40 AND 200 AND t >= 300 AND t < 900 GROUP BY y")
def depth_window_filter(spark, sf_dir):
    s = R.train(spark, sf_dir).where("t >= 300 and t < 900").join(F.broadcast(R.channels(spark)), "channel").where("y between 40 and 200")
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("spike_id").alias("first"), F.max("spike_id").alias("last"), r4(F.sum("amp")).alias("amp"))


@query(f"WITH {REC}, {GEO}, {MP} SELECT CAST(least(floor(t / 2), 978) AS INT) AS tbin, CAST(least(floor(my / 4), 79) AS INT) AS ybin, round(sum(amp), 4) AS amp, count(*) AS n FROM mp WHERE t BETWEEN 0 AND 1958 AND my BETWEEN 0 AND 320 GROUP BY ALL")
def density_raster(spark, sf_dir):
    s = _mp(R.spikes(spark, sf_dir))
    r = rasters.raster(s, {"tbin": rasters.closed_bin(F.col("t"), 0.0, 1958.0, 979), "ybin": rasters.closed_bin(F.col("my"), 0.0, 320.0, 80)}, amp=F.col("amp"))
    return r.withColumn("amp", r4(F.col("amp")))


@query(f"WITH {REC}, {GEO}, {MP} SELECT kind, CAST(floor(t / 10) AS INT) AS tbin, CAST(floor(my / 8) AS INT) AS ybin, count(*) AS n, round(sum(amp), 4) AS amp FROM mp WHERE t < 1958 AND my >= 0 AND my < 320 GROUP BY ALL")
def basis_raster(spark, sf_dir):
    s = _mp(R.spikes(spark, sf_dir))
    r = rasters.raster(s, {"kind": F.col("kind"), "tbin": rasters.open_bin(F.col("t"), 0.0, 10.0, 196), "ybin": rasters.open_bin(F.col("my"), 0.0, 8.0, 40)}, amp=F.col("amp"))
    return r.where("tbin * 10 < 1958").withColumn("amp", r4(F.col("amp")))


@query(f"""WITH {REC}, {GEO}, {LAT} SELECT CAST(floor(t / 50) AS INT) AS tbin, CAST(floor(py / 40) AS INT) AS ybin, count(*) AS n,
    CASE WHEN count(*) >= 4 THEN round(sum((energy - score) / greatest(energy, 1e-12) * amp) / nullif(sum(amp), 0), 4) END AS err FROM loc WHERE py >= 0 AND py < 320 GROUP BY ALL""")
def error_raster(spark, sf_dir):
    """Amplitude-weighted mean relative error by cell; null below four spikes."""
    p = inference.located(R.spikes(spark, sf_dir)).where("py >= 0 and py < 320")
    err = (F.col("energy") - F.col("score")) / F.greatest("energy", F.lit(1e-12))
    g = p.groupBy(F.floor(F.col("t") / 50).cast("int").alias("tbin"), F.floor(F.col("py") / 40).cast("int").alias("ybin"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 4, r4(F.try_divide(F.sum(err * F.col("amp")), F.sum("amp")))).alias("err"))


@query(f"""WITH {REC}, {GEO}, {MP}, u AS (SELECT amp, mx / 10 AS u, my / (10 * sqrt(3)) AS v FROM mp),
    d AS (SELECT *, pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS f FROM u)
    SELECT CASE WHEN f THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN f THEN floor(u + 0.5) ELSE floor(u) END AS BIGINT) AS i, CAST(CASE WHEN f THEN floor(v + 0.5) ELSE floor(v) END AS BIGINT) AS j,
    count(*) AS n, round(avg(amp) + 1e-7, 4) AS amp FROM d GROUP BY ALL""")
def hexbin_mean(spark, sf_dir):
    s = _mp(R.spikes(spark, sf_dir))
    k, i, j = rasters.hexagon(F.col("mx"), F.col("my"), 10.0)
    return s.groupBy(k.alias("lattice"), i.alias("i"), j.alias("j")).agg(F.count(F.lit(1)).alias("n"), r4(F.avg("amp") + 1e-7).alias("amp"))


@query(f"WITH {REC}, {GEO}, {MP} SELECT CAST(floor(t / 100) AS INT) AS bin, CAST(floor(mx / 10) AS INT) AS ix, CAST(floor(my / 20) AS INT) AS iy, CAST(floor(mz / 10) AS INT) AS iz, round(sum(amp), 4) AS amp, count(*) AS n FROM mp WHERE mx >= 0 AND mx < 80 AND my >= 0 AND my < 320 AND mz >= 0 AND mz < 50 GROUP BY ALL")
def voxel_scatter_3d(spark, sf_dir):
    s = _mp(R.spikes(spark, sf_dir))
    bins = {"bin": F.floor(F.col("t") / 100).cast("int"), "ix": rasters.open_bin(F.col("mx"), 0.0, 10.0, 8), "iy": rasters.open_bin(F.col("my"), 0.0, 20.0, 16), "iz": rasters.open_bin(F.col("mz"), 0.0, 10.0, 5)}
    return rasters.raster(s, bins, amp=F.col("amp")).withColumn("amp", r4(F.col("amp")))


@query(f"WITH {REC}, {GEO}, {MP} SELECT CAST(floor(t / 100) AS INT) AS bin, count(*) FILTER (NOT (my >= 20 AND my < 300 AND mz < 12)) AS dropped, count(*) AS n FROM mp GROUP BY bin")
def volume_drop_count(spark, sf_dir):
    s = _mp(R.spikes(spark, sf_dir))
    ok = (F.col("my") >= 20) & (F.col("my") < 300) & (F.col("mz") < 12)
    return s.groupBy(F.floor(F.col("t") / 100).cast("int").alias("bin")).agg(F.count_if(~ok).alias("dropped"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {REC} SELECT channel, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM train), 4) AS share, round(100 * sum(amp) / (SELECT sum(amp) FROM train), 4) AS amp_share FROM train GROUP BY channel")
def atom_usage(spark, sf_dir):
    g = R.train(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("amp").alias("a"))
    w = Window.partitionBy()
    return g.select("channel", "n", r4(100.0 * F.col("n") / F.sum("n").over(w)).alias("share"), r4(100 * F.col("a") / F.sum("a").over(w)).alias("amp_share"))


@query(f"WITH {REC}, g AS (SELECT user_id, count(*) AS n FROM train GROUP BY user_id) SELECT user_id, n, row_number() OVER w AS rank, round(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM g), 4) AS share FROM g WINDOW w AS (ORDER BY n DESC, user_id)")
def concentration_curve(spark, sf_dir):
    g = R.train(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return windows.concentration(g, "user_id", "n").withColumn("share", r4(F.col("share"))).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {REC}, g AS (SELECT user_id, count(*) AS n FROM train GROUP BY user_id), c AS (SELECT row_number() OVER w AS rank, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM g) AS share FROM g WINDOW w AS (ORDER BY n DESC, user_id)) SELECT min(rank) AS half_rank FROM c WHERE share >= 0.5")
def half_mass_rank(spark, sf_dir):
    g = R.train(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return windows.concentration(g, "user_id", "n").where("share >= 0.5").agg(F.min("rank").cast("long").alias("half_rank"))


@query(f"WITH {REC} SELECT kind, round(100 * quantile_cont(amp, 0.25) / (SELECT median(amp) FROM train), 4) AS q25, round(100 * median(amp) / (SELECT median(amp) FROM train), 4) AS med, round(max(amp) * 100 / (SELECT median(amp) FROM train), 4) AS top FROM train GROUP BY kind")
def amp_rescale_median(spark, sf_dir):
    """Amplitudes scaled so that the overall median is 100."""
    s = R.train(spark, sf_dir)
    m = s.agg(F.percentile("amp", F.lit(0.5)).alias("m"))
    g = s.groupBy("kind").agg(F.percentile("amp", F.lit(0.25)).alias("a"), F.percentile("amp", F.lit(0.5)).alias("b"), F.max("amp").alias("c"))
    j = g.join(F.broadcast(m))
    return j.select("kind", *[r4(100 * F.col(x) / F.col("m")).alias(y) for x, y in (("a", "q25"), ("b", "med"), ("c", "top"))])


@query(f"WITH {REC}, s AS (SELECT CAST(floor(t) AS BIGINT) AS sec, count(*) AS n FROM train GROUP BY 1) SELECT n, min(sec) AS sec FROM s GROUP BY n ORDER BY n DESC LIMIT 1")
def densest_second(spark, sf_dir):
    s = R.train(spark, sf_dir).groupBy(F.floor("t").alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    b = F.max(F.struct("n", (-F.col("sec")).alias("neg"))).alias("b")
    return s.agg(b).select(F.col("b.n").alias("n"), (-F.col("b.neg")).alias("sec"))


@query(f"WITH {REC} SELECT CAST(c.channel AS INT) AS channel, k.kind, count(t.spike_id) AS n, round(coalesce(sum(t.amp), 0), 4) AS amp FROM range(64) c(channel) CROSS JOIN (SELECT DISTINCT kind FROM train) k LEFT JOIN train t ON t.channel = c.channel AND t.kind = k.kind GROUP BY ALL")
def zero_filled_counts(spark, sf_dir):
    """Counts with a row for every channel and kind, also the empty ones."""
    s = R.train(spark, sf_dir)
    g = s.groupBy("channel", "kind").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("amp")).alias("amp"))
    domain = s.select("kind").distinct().select("kind", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("channel"))
    return rasters.filled(g, domain, ["channel", "kind"]).select("channel", "kind", "n", "amp")


@query(f"WITH {REC}, {GEO}, {LAT}, r AS (SELECT * FROM loc JOIN (SELECT channel AS c, y FROM ch) q ON q.c = loc.channel) SELECT round(corr(py, y), 4) AS r, round(regr_slope(py, y), 4) AS slope, count(*) AS n FROM r")
def localization_vs_reference(spark, sf_dir):
    p = inference.located(R.spikes(spark, sf_dir)).join(F.broadcast(R.channels(spark).select("channel", "y")), "channel")
    return p.agg(r4(F.corr("py", "y")).alias("r"), r4(F.regr_slope("py", "y")).alias("slope"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {REC}, s AS (SELECT a.kind, a.zw, r1.j AS i, r2.j FROM z a, range(8) r1(j), range(8) r2(j) WHERE r1.j <= r2.j)
    SELECT kind, i, j, round(sum(list_sum(list_transform(range(8), lambda c: zw[c * 8 + i + 1] * zw[c * 8 + j + 1]))), 4) AS scatter FROM s GROUP BY ALL""")
def pca_scatter(spark, sf_dir):
    """Sum of outer products over time samples, upper triangle."""
    return learning.scatters(R.spikes(spark, sf_dir), "kind").where("i <= j").select("kind", "i", "j", r4("v").alias("scatter"))


@query(f"WITH {REC}, g AS (SELECT avg(list_sum(zw) / 64) AS m FROM z) SELECT channel, round(avg(list_sum(w) / 64), 4) AS mean_all, round(avg(list_sum(w[1:8]) / 8), 4) AS mean_slot0, round(stddev_pop(amp), 4) AS sd FROM z GROUP BY channel")
def references_mean_floors(spark, sf_dir):
    s = R.spikes(spark, sf_dir)
    return s.groupBy("channel").agg(r4(F.avg(A.total(F.col("w")) / 64)).alias("mean_all"), r4(F.avg(A.total(F.slice("w", 1, 8)) / 8)).alias("mean_slot0"), r4(F.stddev_pop("amp")).alias("sd"))


@query(f"""WITH {REC}, p AS (SELECT kind, w[1:8] AS v FROM z), a AS (SELECT kind, v, list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x)))) AS k FROM p),
    o AS (SELECT kind, v[k] > 0 AS up, unnest(list_transform(range(8), lambda i: v[((i + k - 1 - 4 + 16) % 8) + 1])) AS x, unnest(range(8)) AS i FROM a)
    SELECT kind, up, i, round(avg(x), 4) AS x, count(*) AS n FROM o GROUP BY ALL""")
def peak_align_mean(spark, sf_dir):
    """Mean of the first rows rolled so that their largest magnitude is at sample 4, by sign."""
    s = R.spikes(spark, sf_dir).select("kind", F.slice("w", 1, 8).alias("v"))
    mag = F.transform("v", lambda x: F.abs(x))
    s = s.withColumn("k", F.array_position(mag, F.array_max(mag)).cast("int"))
    rolled = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.element_at(F.col("v"), ((i + F.col("k") + 11) % 8 + 1).cast("int")))
    o = s.select("kind", (F.element_at("v", F.col("k")) > 0).alias("up"), F.posexplode(rolled).alias("i", "x"))
    return o.groupBy("kind", "up", F.col("i").cast("long").alias("i")).agg(r4(F.avg("x")).alias("x"), F.count(F.lit(1)).alias("n"))


# windows, samples, sets


@query(f"WITH {REC} SELECT spike_id, channel, kind FROM train QUALIFY row_number() OVER (PARTITION BY channel ORDER BY (spike_id * 7919 + 104729) % 10007, spike_id) <= 5")
def capped_sample_per_group(spark, sf_dir):
    return windows.sample_per_group(R.train(spark, sf_dir), "channel", "spike_id", 5).select("spike_id", "channel", "kind")


@query(f"WITH {REC} SELECT spike_id, channel, round((row_number() OVER (PARTITION BY channel ORDER BY amp, spike_id) - 1) / greatest(count(*) OVER (PARTITION BY channel) - 1, 1), 4) AS rank01 FROM train")
def rank_equalize(spark, sf_dir):
    return windows.rank_equalized(R.train(spark, sf_dir), ["channel"], "amp", "spike_id").select("spike_id", "channel", r4(F.col("rank01")).alias("rank01"))


@query(f"""WITH {REC}, {GEO}, {MP}, b AS (SELECT my, amp, unnest(range(CAST(ceil((my - 50) / 50) AS BIGINT), CAST(floor((my + 50) / 50) AS BIGINT) + 1)) AS block FROM mp)
    SELECT block, count(*) AS n, round(sum(greatest(0, 1 - abs(my - block * 50) / 50) + 0.001), 4) AS weight, round(sum(amp), 4) AS amp FROM b GROUP BY block""")
def depth_block_expand(spark, sf_dir):
    s = _mp(R.spikes(spark, sf_dir)).select("my", "amp", windows.overlapping_blocks(F.col("my"), 50.0, 50.0).alias("block"))
    return s.groupBy("block").agg(F.count(F.lit(1)).alias("n"), r4(F.sum(windows.blend_weight(F.col("my"), F.col("block"), 50.0, 50.0))).alias("weight"), r4(F.sum("amp")).alias("amp"))


@query(f"WITH {REC}, b AS (SELECT DISTINCT CAST(floor(t) AS BIGINT) AS bin FROM train) SELECT bin FROM b QUALIFY (row_number() OVER (ORDER BY bin) - 1) % 8 = 0")
def strided_bins(spark, sf_dir):
    return windows.every(R.train(spark, sf_dir).select(F.floor("t").alias("bin")).distinct(), "bin", 8)


@query(f"WITH {REC}, b AS (SELECT DISTINCT channel, CAST(floor(t) AS BIGINT) AS bin FROM train), g AS (SELECT channel, bin, bin - row_number() OVER (PARTITION BY channel ORDER BY bin) AS g FROM b) SELECT channel, min(bin) AS first, max(bin) AS last, count(*) AS length FROM g GROUP BY channel, g")
def contiguous_bin_runs(spark, sf_dir):
    b = R.train(spark, sf_dir).select("channel", F.floor("t").alias("bin")).distinct()
    return windows.runs(b, "bin", ("channel",))


@query(f"WITH {REC} SELECT kind, spike_id, round(amp - lag(amp) OVER (PARTITION BY kind ORDER BY spike_id), 4) AS diff FROM train")
def first_differences(spark, sf_dir):
    d = windows.differences(R.train(spark, sf_dir).select("kind", "spike_id", "amp"), "kind", "spike_id", "amp", 8192)
    return d.select("kind", "spike_id", r4("diff").alias("diff"))


@query(f"WITH {REC}, a AS (SELECT DISTINCT CAST(floor(t) AS BIGINT) AS bin FROM train WHERE kind = 'click'), b AS (SELECT DISTINCT CAST(floor(t) AS BIGINT) AS bin FROM train WHERE kind = 'view') SELECT 'both' AS what, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'any', count(*) FROM (FROM a UNION FROM b)")
def eligible_bins(spark, sf_dir):
    """Intersection, difference and union of the seconds in which two kinds are active."""
    s = R.train(spark, sf_dir)
    a, b = (s.where(F.col("kind") == k).select(F.floor("t").alias("bin")) for k in ("click", "view"))
    parts = [("both", a.intersect(b)), ("only", a.subtract(b)), ("any", a.union(b).distinct())]
    out = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, d in parts]
    return out[0].union(out[1]).union(out[2])


@query(f"""WITH {REC}, {GEO}, g AS (SELECT CAST(floor(t / 10) AS BIGINT) AS bin, count(*) AS n FROM train GROUP BY 1)
    SELECT a.bin, round(sum(b.n * exp(-pow(a.bin - b.bin, 2) / 8.0)), 4) AS smooth FROM g a JOIN g b ON b.bin BETWEEN a.bin - 6 AND a.bin + 6 GROUP BY a.bin""")
def gaussian_smooth(spark, sf_dir):
    """Zero-padded Gaussian blur over time bins, by an equality on shifted bins."""
    g = R.train(spark, sf_dir).groupBy(F.floor(F.col("t") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = g.select(F.explode(F.sequence(F.col("bin") - 6, F.col("bin") + 6)).alias("at"), "bin", "n")
    s = spread.groupBy("at").agg(F.sum(F.col("n") * F.exp(-F.pow(F.col("at") - F.col("bin"), 2) / 8.0)).alias("smooth"))
    return g.join(s, g.bin == s["at"]).select("bin", r4(F.col("smooth")).alias("smooth"))


# motion


@query(f"WITH {REC}, {WAY} SELECT spike_id, round(p0 + (least(t, 1958) - t0) / (t1 - t0) * (p1 - p0) + 1e-7, 4) AS gt FROM train JOIN seg ON least(t, 1958) >= t0 AND (least(t, 1958) < t1 OR t1 = 1958)")
def gt_interp(spark, sf_dir):
    s = R.train(spark, sf_dir).select("spike_id", "t")
    return interpolate.interpolated(s, R.waypoints(spark), 100.0, "gt").select("spike_id", r4(F.col("gt") + 1e-7).alias("gt"))


@query(f"WITH {REC}, {GEO}, {MP}, {WAY}, c AS (SELECT my - (p0 + (least(t, 1958) - t0) / (t1 - t0) * (p1 - p0)) AS yc FROM mp JOIN seg ON least(t, 1958) >= t0 AND (least(t, 1958) < t1 OR t1 = 1958)) SELECT CAST(floor(yc / 20) AS BIGINT) AS iy, count(*) AS n, round(sum(yc), 3) AS y FROM c GROUP BY 1")
def correct_rigid(spark, sf_dir):
    """Depths less the interpolated motion, by depth pixel."""
    s = _mp(R.spikes(spark, sf_dir)).select("spike_id", "t", "my")
    c = interpolate.interpolated(s, R.waypoints(spark), 100.0).withColumn("yc", F.col("my") - F.col("p"))
    return c.groupBy(F.floor(F.col("yc") / 20).alias("iy")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("yc"), 3).alias("y"))


@query(f"""WITH {REC}, {GEO}, {MP}, {WAY}, c AS (SELECT my, p0 + (least(t, 1958) - t0) / (t1 - t0) * (p1 - p0) AS p FROM mp JOIN seg ON least(t, 1958) >= t0 AND (least(t, 1958) < t1 OR t1 = 1958)),
    d AS (SELECT my, p, least(greatest((my - 50) / 100, 0), 2) AS h FROM c), e AS (SELECT *, CAST(least(floor(h), 1) AS BIGINT) AS win, h - least(floor(h), 1) AS f FROM d)
    SELECT win, count(*) AS n, round(sum(my - ((1 - f) * p * (1 + 0.1 * win) + f * p * (1 + 0.1 * (win + 1)))), 3) AS y FROM e GROUP BY win""")
def correct_nonrigid(spark, sf_dir):
    """Depths less a motion table of three depth windows (centres 50, 150, 250 um), interpolated over time and depth."""
    s = _mp(R.spikes(spark, sf_dir)).select("spike_id", "t", "my")
    w = R.waypoints(spark)
    knots = w.select(F.col("t0").alias("t"), F.col("p0").alias("p")).union(w.select("t1", "p1")).distinct()
    table = knots.select("t", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("win"), "p").withColumn("p", F.col("p") * (1 + 0.1 * F.col("win")))
    c = interpolate.at_depth(s, table, 50.0, 100.0, 3, 100.0, "my").withColumn("yc", F.col("my") - F.col("p"))
    h = F.least(F.greatest((F.col("my") - 50) / 100, F.lit(0.0)), F.lit(2.0))
    return c.groupBy(F.least(F.floor(h), F.lit(1)).cast("long").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("yc"), 3).alias("y"))


@query(f"WITH {REC}, {GEO}, {MP}, b AS (SELECT least(floor(t / (1958.0 / 60)), 59) AS b, avg(0 + (least(floor(my / (320.0 / 80)), 79) + 0.5) * 4.0) AS com FROM mp WHERE my BETWEEN 0 AND 320 AND t BETWEEN 0 AND 1958 GROUP BY 1) SELECT round(stddev_pop(com), 4) AS flatness, count(*) AS bins FROM b")
def flatness(spark, sf_dir):
    f = motion.flatness(_mp(R.spikes(spark, sf_dir)), "my", 60, 0.0, 320.0, 80, 1958.0)
    return f.select(r4(F.col("flatness")).alias("flatness"), "bins")


def _trace(spark, sf_dir) -> DataFrame:
    """t, p (mean depth of a time bin), gt."""
    s = _mp(R.spikes(spark, sf_dir)).groupBy(F.floor(F.col("t") / 10).alias("bin")).agg(F.avg("my").alias("p"))
    return interpolate.interpolated(s.select((F.col("bin") * 10 + 5).cast("double").alias("t"), "p"), R.waypoints(spark), 100.0, "gt")


_TRACE = f"""{REC}, {GEO}, {MP}, {WAY}, b AS (SELECT CAST(floor(t / 10) * 10 + 5 AS DOUBLE) AS t, avg(my) AS p FROM mp GROUP BY 1),
    tc AS (SELECT t, p, p0 + (least(t, 1958) - t0) / (t1 - t0) * (p1 - p0) AS gt FROM b JOIN seg ON least(t, 1958) >= t0 AND (least(t, 1958) < t1 OR t1 = 1958))"""


@query(f"WITH {_TRACE} SELECT round(corr(p, gt), 4) AS r, round(covar_pop(p, gt) / var_pop(gt), 4) AS gain, round(sqrt(avg(pow(p - gt, 2)) - pow(avg(p - gt), 2)), 4) AS rmse, round(max(p) - min(p), 4) AS p_range, round(max(gt) - min(gt), 4) AS gt_range FROM tc")
def score_gt_simple(spark, sf_dir):
    s = motion.simple_score(_trace(spark, sf_dir))
    return s.select(*[r4(F.col(c)).alias(c) for c in s.columns])


@query(f"WITH {_TRACE}, d AS (SELECT p - lag(p) OVER (ORDER BY t) AS dp, gt - lag(gt) OVER (ORDER BY t) AS dg FROM tc) SELECT round(corr(dp, dg), 4) AS step_r, count(*) AS n FROM d WHERE dp IS NOT NULL")
def score_gt_steps(spark, sf_dir):
    s = motion.step_score(_trace(spark, sf_dir))
    return s.select(r4(F.col("step_r")).alias("step_r"), "n")


_PAIRS = f"""{REC}, {GEO}, {MP}, pr AS (SELECT CAST(floor(t / 100) AS BIGINT) AS bin, CAST(floor(my / 10) AS BIGINT) AS iy, sum(amp) AS w FROM mp GROUP BY ALL),
    pg AS (SELECT bin, iy, coalesce(w, 0) AS w FROM (SELECT DISTINCT bin FROM pr) b CROSS JOIN range(32) g(iy) LEFT JOIN pr USING (bin, iy)),
    pc AS (SELECT bin, iy, w - avg(w) OVER (PARTITION BY bin) AS w FROM pg), pn AS (SELECT bin, iy, w / sqrt(sum(w * w) OVER (PARTITION BY bin)) AS v FROM pc),
    ps AS (SELECT bin, iy + lag AS iy, lag, v FROM pn, range(-8, 9) l(lag)),
    lg AS (SELECT a.bin AS t, b.bin AS u, b.lag, sum(a.v * b.v) AS r FROM pn a JOIN ps b ON a.iy = b.iy AND a.bin > b.bin GROUP BY ALL),
    hp AS (SELECT t, u, lag * 10.0::DOUBLE AS d, round(r, 9) AS c FROM lg QUALIFY row_number() OVER (PARTITION BY t, u ORDER BY round(r, 9) DESC, lag) = 1)"""


def _lagged(spark, sf_dir) -> DataFrame:
    """All pairs of time bins of 100 s, at lags of up to 80 um."""
    return motion.lagged_pairs(motion.profiles(_mp(R.spikes(spark, sf_dir)), 100.0, "my", 10.0), 8, 0, 32)


@query(f"WITH {_PAIRS} SELECT t, u, d, round(c, 4) AS c FROM hp")
def zncc_pairs(spark, sf_dir):
    p = motion.hard_pairs(_lagged(spark, sf_dir), 10.0)
    return p.select("t", "u", "d", r4(F.col("c")).alias("c"))


@query(f"WITH {_PAIRS} SELECT t, u, round(sum(exp((r - 1) / 0.2) * lag) / sum(exp((r - 1) / 0.2)) * 10, 4) AS d, round(sum(exp((r - 1) / 0.2) * r) / sum(exp((r - 1) / 0.2)), 4) AS c FROM lg GROUP BY t, u")
def soft_zncc_pairs(spark, sf_dir):
    p = motion.soft_pairs(_lagged(spark, sf_dir), 10.0, 0.2)
    return p.select("t", "u", r4(F.col("d")).alias("d"), r4(F.col("c")).alias("c"))


@query(f"WITH {_PAIRS} SELECT t, u, d, round(pow(greatest(c - 0.3, 0), 2), 4) AS w FROM hp WHERE t - u <= 2")
def pair_matrix_weights(spark, sf_dir):
    p = motion.weights(motion.hard_pairs(_lagged(spark, sf_dir), 10.0), 0.3, 2.0, 2)
    return p.select("t", "u", "d", r4(F.col("w")).alias("w"))


@query(f"WITH {_PAIRS}, b AS (SELECT t, u, d, c FROM hp UNION ALL SELECT u, t, 5 - d, c FROM hp) SELECT a.t, a.u, CASE WHEN abs(a.d) <= abs(-b.d) THEN a.d ELSE -b.d END AS d, round((a.c + b.c) / 2, 4) AS c FROM b a JOIN b ON b.t = a.u AND b.u = a.t")
def reciprocity_contract(spark, sf_dir):
    """The contract applied to pairs whose two directions disagree."""
    p = motion.hard_pairs(_lagged(spark, sf_dir), 10.0)
    both = p.union(p.select(F.col("u").alias("t"), F.col("t").alias("u"), (5 - F.col("d")).alias("d"), "c"))
    r = motion.reciprocal(both, True)
    return r.select("t", "u", "d", r4(F.col("c")).alias("c"))


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, count(DISTINCT d) AS displacements, round(avg(CASE WHEN d <> 0 THEN 1.0 ELSE 0.0 END), 4) AS nonzero, round(avg(c), 4) AS mean_c FROM hp")
def pair_summary(spark, sf_dir):
    """How many pairs, how many distinct displacements, how often they differ from zero, and the mean correlation."""
    p = motion.hard_pairs(_lagged(spark, sf_dir), 10.0)
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("d").alias("displacements"), r4(F.avg((F.col("d") != 0).cast("double"))).alias("nonzero"), r4(F.avg("c")).alias("mean_c"))


@query()
def rigid_solve(spark, sf_dir):
    p = motion.weights(motion.soft_pairs(_lagged(spark, sf_dir), 10.0, 0.2), 0.1, 2.0, 3)
    return motion.solved(p).select("t", F.round("p", 3).alias("p"))


@query()
def nonrigid_solve(spark, sf_dir):
    """Motion of overlapping depth windows of 160 um over the whole probe, with lags of 80 um, solved apart."""
    s = _mp(R.spikes(spark, sf_dir))
    # a cell a time bin and depth pixel, read by every window: made once
    prof = kept(motion.profiles(s, 200.0, "my", 10.0), "profiles")
    out = None
    for win in range(3):  # a fixed number of windows
        pairs = motion.lagged_pairs(prof, 8, 8 * win, 8 * win + 16)
        p = motion.weights(motion.soft_pairs(pairs, 10.0, 0.2), 0.1, 2.0, 3).withColumn("win", F.lit(win))
        out = p if out is None else out.union(p)
    return motion.solved(out, "win").select("win", "t", F.round("p", 3).alias("p"))


@query()
def control_ladder(spark, sf_dir):
    """Motion and its scores when depths are shrunk towards the channel: 0 is the control without localisation."""
    s = _mp(R.spikes(spark, sf_dir))
    rows, steps = [], (0.0, 0.25, 0.5, 1.0)
    # the profiles of all steps of the ladder, of one pass over the spikes
    prof = kept(motion.ladder(s, 100.0, {k: F.col("y") + k * (F.col("my") - F.col("y")) for k in steps}, 10.0), "ladder")
    for k in steps:
        p = motion.solved(motion.weights(motion.soft_pairs(motion.lagged_pairs(prof.where(F.col("k") == k), 8, 0, 32, 3), 10.0, 0.2), 0.1, 2.0, 3))
        trace = interpolate.interpolated(p.select((F.col("t") * 100.0 + 50).alias("t"), "p"), R.waypoints(spark), 100.0, "gt")
        r, gain, left = motion.detrended_score(trace)
        rows.append((k, round(r, 3), round(gain, 3), round(left, 3)))
    return spark.createDataFrame(rows, "shrink double, r double, gain double, residual double")


# learning


@query()
def codebook_fit(spark, sf_dir):
    """Error by iteration of the alternating fit; it never rises."""
    _, history = learning.fit(R.spikes(spark, sf_dir))
    return spark.createDataFrame([(h["iteration"], h["alpha"], round(h["nmse"], 6)) for h in history], "iteration int, alpha double, nmse double")


@query()
def block_pca_scores(spark, sf_dir):
    """Scores of each spike's first row in the principal axes of its channel, equalised by rank."""
    s = R.spikes(spark, sf_dir).select("spike_id", "channel", F.slice("w", 1, 8).alias("v"))
    p = learning.block_pca(s, "channel", "v", "spike_id")
    return windows.rank_equalized(p, ["channel"], "pc0", "spike_id").select("spike_id", "channel", F.round("pc0", 5).alias("pc0"), r4(F.col("rank01")).alias("rank01"))


@query()
def stream_tumbling_bins(spark, sf_dir):
    """Events by tumbling hour through a streaming query."""
    import uuid

    from tidemark.session import shared_dir
    from tidemark.streaming.bins import drained, tumbling

    shared = shared_dir(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), "value")
    name = f"bins_{uuid.uuid4().hex}"
    out = drained(tumbling(e, "1 hour", "1 minute"), name, f"{shared}/{name}")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n", r4(F.col("amp")).alias("amp"))


# strings, tables, quantisation


@query(f"""WITH {REC}, g AS (SELECT 'run_' || kind || '_M' || CAST(channel % 4 AS VARCHAR) || '_R' || CAST(user_id % 3 AS VARCHAR) AS tag, amp FROM train)
    SELECT regexp_extract(tag, '^run_([a-z]+)_', 1) AS family, CAST(regexp_extract(tag, '_M([0-9]+)', 1) AS INT) AS m, CAST(regexp_extract(tag, '_R([0-9]+)', 1) AS INT) AS r, count(*) AS n, round(avg(amp), 4) AS amp FROM g GROUP BY ALL""")
def tag_regex_parse(spark, sf_dir):
    """Builds run tags from fields and reads the fields back from the tags."""
    tag = F.concat(F.lit("run_"), "kind", F.lit("_M"), (F.col("channel") % 4).cast("string"), F.lit("_R"), (F.col("user_id") % 3).cast("string"))
    g = R.train(spark, sf_dir).select(tag.alias("tag"), "amp")
    return g.groupBy(F.regexp_extract("tag", "^run_([a-z]+)_", 1).alias("family"), F.regexp_extract("tag", "_M([0-9]+)", 1).cast("int").alias("m"), F.regexp_extract("tag", "_R([0-9]+)", 1).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n"), r4(F.avg("amp")).alias("amp"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k, count(*) AS n, round(avg(value), 4) AS amp FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), r4(F.avg("value")).alias("amp"))


@query(f"WITH {REC}, h AS (SELECT min(amp) AS lo, max(amp) AS hi FROM train) SELECT spike_id, CAST(floor((amp - lo) / (hi - lo) * 65535) AS INT) AS q FROM train, h")
def quantize_u16(spark, sf_dir):
    s = R.train(spark, sf_dir)
    h = s.agg(F.min("amp").alias("lo"), F.max("amp").alias("hi"))
    j = s.join(F.broadcast(h))
    return j.select("spike_id", F.floor((F.col("amp") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 65535).cast("int").alias("q"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS v, round(max(o_totalprice), 2) AS price, CAST(NULL AS VARCHAR) AS status FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    b AS (SELECT o_custkey AS k, max(o_orderkey) AS v, CAST(NULL AS DOUBLE) AS price, max(o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
    u AS (FROM a UNION ALL FROM b) SELECT k, max(v) AS v, arg_max(price, v) FILTER (price IS NOT NULL) AS price, arg_max(status, v) FILTER (status IS NOT NULL) AS status FROM u GROUP BY k""")
def metrics_upsert(spark, sf_dir):
    """Two partial tables merged by key: newest non-null value of each field."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("k"), "o_totalprice", "o_orderstatus")
    a = o.where("o_orderkey % 2 = 0").groupBy("k").agg(F.max("o_orderkey").alias("v"), F.round(F.max("o_totalprice"), 2).alias("price"))
    b = o.where("o_orderkey % 2 = 1").groupBy("k").agg(F.max("o_orderkey").alias("v"), F.max("o_orderstatus").alias("status"))
    return tables.upserted(a, b, ["k"], "v").select("k", "v", "price", "status")


@query("""SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS orders, total, CASE WHEN n IS NULL THEN 'control' ELSE 'run' END AS row_kind FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def run_index_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    j = c.join(o, "c_custkey", "left")
    return j.select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("orders"), "total", F.when(F.col("n").isNull(), "control").otherwise("run").alias("row_kind"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def metric_cube(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


from tidemark import fit_queries, model_queries, motion_queries, source_queries, storage_queries, view_queries  # noqa: E402, F401 - they register their queries here
