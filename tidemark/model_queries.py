"""Registered queries of solvers, state tables, voxel geometry and pair predicates, with their DuckDB SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.operators import inference, motion, rasters, solvers, state, volume
from tidemark.plans.oracle import GEO, LAT, REC
from tidemark.queries import _PAIRS, MP, SHARES, _lagged, _mp, query, r4
from tidemark.session import shared_dir
from tidemark.sources import recording as R

#: u of the two best places of each spike, their norms, overlap and inner product.
TWO = f"""{REC}, {GEO}, {LAT}, t2 AS (SELECT spike_id, n, score, row_number() OVER (PARTITION BY spike_id ORDER BY round(score, 9) DESC, n) AS rn FROM sc QUALIFY rn <= 2),
    uu AS (SELECT t2.spike_id, pj.channel, rn, t2.n, score, m, any_value(g) AS g, any_value(list_sum(list_transform(range(1, 9), lambda c: g[c] * p[c]))) AS u FROM t2 JOIN pj USING (spike_id) JOIN fp ON fp.channel = pj.channel AND fp.n = t2.n GROUP BY ALL),
    pr AS (SELECT a.spike_id, any_value(a.channel) AS channel, any_value(a.n) AS n1, any_value(b.n) AS n2, any_value(a.score) AS s1, any_value(b.score) AS s2, any_value(list_sum(list_transform(range(1, 9), lambda i: a.g[i] * b.g[i]))) AS c, sum(a.u * b.u) AS x FROM uu a JOIN uu b ON a.spike_id = b.spike_id AND a.m = b.m AND a.rn = 1 AND b.rn = 2 GROUP BY a.spike_id)"""


@query(f"""WITH {TWO}, q AS (SELECT channel, s1 + s2 - 2 * x AS a, 2 * (x - s2) AS b, 2 * (1 - c) AS d, s2 FROM pr),
    e AS (SELECT *, -d * (a + b) AS p, 2 * (a - d * s2) AS q, b + d * s2 AS r FROM q),
    w AS (SELECT *, unnest([1.0::DOUBLE, 0, CASE WHEN abs(p) > 1e-12 THEN greatest(0, least(1, (-q + sqrt(greatest(q * q - 4 * p * r, 0))) / (2 * p))) ELSE 0 END, CASE WHEN abs(p) > 1e-12 THEN greatest(0, least(1, (-q - sqrt(greatest(q * q - 4 * p * r, 0))) / (2 * p))) ELSE 0 END, CASE WHEN abs(q) > 1e-12 THEN greatest(0, least(1, -r / q)) ELSE 0 END]) AS w, row_number() OVER () AS i FROM e),
    g AS (SELECT i, any_value(channel) AS channel, max((a * w * w + b * w + s2) / greatest(d * w * w - d * w + 1, 1e-12)) AS got FROM w GROUP BY i)
    SELECT channel, count(*) AS n, round(sum(got), 3) AS captured FROM g GROUP BY channel""".replace("row_number() OVER () AS i FROM e", "i FROM (SELECT *, row_number() OVER () AS i FROM e)"))
def shared_pair_weight(spark, sf_dir):
    """What the two best places of each spike capture with one common shape, at the best weight between them."""
    s = R.spikes(spark, sf_dir)
    omega, shapes = inference.dct(4), inference.shapes_by_channel(spark)

    def run(batches):
        for batch in batches:
            channel = batch.column(0).to_numpy()
            u = inference.coefficients(inference.centred(batch.column(1)), shapes[channel], omega)
            order, here = np.argsort(-np.round(np.einsum("bnm,bnm->bn", u, u), 9), axis=1, kind="stable"), np.arange(len(u))
            one, two = order[:, 0], order[:, 1]
            c = np.einsum("bc,bc->b", shapes[channel, :, one], shapes[channel, :, two])
            _, got = solvers.shared_pair(u[here, one], u[here, two], c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["channel", "got"])

    g = s.select("channel", "w").mapInArrow(run, "channel int, got double").groupBy("channel")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("got"), 3).alias("captured"))


@query(f"""WITH {TWO}, r AS (SELECT *, (s1 + s2 - 2 * c * x) / greatest(1 - c * c, 1e-12) AS captured, (1 + abs(c)) / greatest(1 - abs(c), 1e-12) AS condition FROM pr),
    f AS (SELECT r.*, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2) AS apart FROM r JOIN cand a ON a.n = n1 JOIN cand b ON b.n = n2),
    k AS (SELECT *, apart >= 25 AND condition <= 40 AS valid, captured - s1 > 0.02 * s1 AS gains FROM f)
    SELECT valid, gains, count(*) AS n, round(avg(apart), 3) AS apart FROM k GROUP BY ALL""")
def accepted_pairs(spark, sf_dir):
    """Pair predicates: places far enough apart and well conditioned; acceptance by the gain over the better single one."""
    lat = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(inference.LATTICE)], "n long, px double, py double, pz double")
    p = inference.pair_terms(R.spikes(spark, sf_dir))
    a, b = (F.broadcast(lat.select(F.col("n").alias(f"n{k}"), *[F.col(x).alias(f"{x}{k}") for x in ("px", "py", "pz")])) for k in (1, 2))
    apart = F.sqrt(sum((F.pow(F.col(f"{x}1") - F.col(f"{x}2"), 2) for x in ("py", "pz")), F.pow(F.col("px1") - F.col("px2"), 2)))
    k = p.join(a, "n1").join(b, "n2").withColumn("apart", apart)
    k = k.select("apart", ((F.col("apart") >= 25) & (F.col("condition") <= 40)).alias("valid"), (F.col("captured") - F.col("s1") > 0.02 * F.col("s1")).alias("gains"))
    return k.groupBy("valid", "gains").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("apart"), 3).alias("apart"))


@query(f"""WITH {REC}, {GEO}, h AS (SELECT spike_id, {SHARES} AS h FROM z), s AS (SELECT spike_id, len(list_filter(h, lambda x: x > 0.1)) AS support, list_max(h) AS top FROM h)
    SELECT round(avg(support), 4) AS support_mean, round(avg(CASE WHEN support > 1 THEN 1.0 ELSE 0.0 END), 4) AS multi_fraction, round(avg(top), 4) AS mass_top FROM s""")
def support_summary(spark, sf_dir):
    """Mean number of slots that hold over a tenth, share of spikes with several, mean largest share."""
    h = R.spikes(spark, sf_dir).select(A.shares(A.peak_to_peak(F.col("w"), 8, 8)).alias("h"))
    s = h.select(F.size(F.filter("h", lambda x: x > 0.1)).alias("support"), F.array_max("h").alias("top"))
    return s.agg(r4(F.avg("support")).alias("support_mean"), r4(F.avg((F.col("support") > 1).cast("double"))).alias("multi_fraction"), r4(F.avg("top")).alias("mass_top"))


@query(f"""WITH {REC}, h AS (SELECT spike_id, unnest(ptp) AS p, unnest(range(8)) AS slot FROM z), k AS (SELECT spike_id, slot, row_number() OVER (PARTITION BY spike_id ORDER BY p DESC, slot) - 1 AS rank FROM h)
    SELECT rank, slot, count(*) AS n FROM k GROUP BY ALL""")
def canonical_order(spark, sf_dir):
    """Slots of each spike in canonical order, by how often each comes at each rank."""
    slots = F.transform(A.peak_to_peak(F.col("w"), 8, 8), lambda p, i: F.struct(p.alias("p"), i.cast("long").alias("slot")))
    s = R.spikes(spark, sf_dir).select(F.posexplode(state.canonical(slots, "p")).alias("rank", "s"))
    return s.groupBy(F.col("rank").cast("long").alias("rank"), F.col("s.slot").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REC}, {GEO}, {MP} SELECT round_even(my / 20, 0) * 20 AS y, round_even(mx / 10, 0) * 10 AS x, count(*) AS n, round(sum(least(greatest(my, 40.001), 199.999)), 3) AS held FROM mp GROUP BY ALL")
def quantised_anchors(spark, sf_dir):
    """Centroids on the voxel lattice (halves to even), and their depth held inside a window."""
    s = _mp(R.spikes(spark, sf_dir))
    g = s.groupBy(volume.quantised(F.col("my"), 20.0).alias("y"), volume.quantised(F.col("mx"), 10.0).alias("x"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(volume.inside(F.col("my"), 40.0, 200.0)), 3).alias("held"))


@query(f"""WITH {REC}, {GEO}, s AS (SELECT CAST(floor(t / 100) AS BIGINT) AS bin, channel, sum(amp) AS w FROM train GROUP BY ALL),
    p AS (SELECT channel, CAST(round_even(y / 10, 0) AS BIGINT) + k AS iy, 1 - abs(k) / 3.0 AS f FROM ch, range(-2, 3) r(k))
    SELECT bin, CASE WHEN iy BETWEEN 0 AND 31 THEN iy ELSE -1 END AS iy, round(sum(w * f), 4) AS w FROM s JOIN p USING (channel) GROUP BY ALL""")
def patch_scatter(spark, sf_dir):
    """Two-stage scatter: amplitudes summed by time bin and channel, then spread over each channel's patch."""
    s = R.train(spark, sf_dir).groupBy(F.floor(F.col("t") / 100).alias("bin"), "channel").agg(F.sum("amp").alias("w"))
    return volume.patches(s, R.channels(spark), 10.0, 2, 0, 32).select("bin", "iy", r4("w").alias("w"))


def _blur_sql(rule: str) -> str:
    src = {"zero": "px0 + k", "reflect": "CASE WHEN ((px0 + k) % 64 + 64) % 64 < 32 THEN ((px0 + k) % 64 + 64) % 64 ELSE 63 - ((px0 + k) % 64 + 64) % 64 END", "nearest": "least(greatest(px0 + k, 0), 31)"}[rule]
    return f"""WITH {REC}, {GEO}, {MP}, d AS (SELECT kind, CAST(floor(my / 10) AS BIGINT) AS iy, sum(amp) AS w FROM mp WHERE my >= 0 AND my < 320 GROUP BY ALL),
        tp AS (SELECT k, exp(-0.5 * (k / 2.0) ** 2) / sum(exp(-0.5 * (k / 2.0) ** 2)) OVER () AS f FROM range(-6, 7) r(k)),
        pl AS (SELECT kind, px0, {src} AS iy, f FROM (SELECT DISTINCT kind FROM d) q, range(32) g(px0), tp)
        SELECT kind, px0 AS iy, round(coalesce(sum(w * f), 0), 4) AS smooth FROM pl LEFT JOIN d USING (kind, iy) GROUP BY ALL"""


def _blur_query(rule: str) -> None:
    def run(spark, sf_dir):
        s = _mp(R.spikes(spark, sf_dir)).where("my >= 0 and my < 320")
        d = s.groupBy("kind", F.floor(F.col("my") / 10).alias("iy")).agg(F.sum("amp").alias("w"))
        return volume.blurred(d, ["kind"], "iy", "w", 2.0, 32, rule).select("kind", "iy", r4("smooth").alias("smooth"))

    run.__name__ = f"blur_{rule}"
    query(_blur_sql(rule))(run)


for _rule in ("zero", "reflect", "nearest"):
    _blur_query(_rule)


_HEAT = f"""{REC}, {GEO}, {MP}, d AS (SELECT CAST(floor(t / 100) AS BIGINT) AS bin, CAST(floor(my / 10) AS BIGINT) AS iy, sum(amp) AS w FROM mp WHERE my >= 0 AND my < 320 GROUP BY ALL)"""


@query(f"""WITH {_HEAT}, m AS (SELECT bin, iy AS mode FROM d QUALIFY row_number() OVER (PARTITION BY bin ORDER BY round(w, 9) DESC, iy) = 1),
    a AS (SELECT bin, sum(iy * w) / sum(w) AS mean FROM d GROUP BY bin), b AS (SELECT bin, sum(iy * w) / sum(w) AS mean FROM d JOIN m USING (bin) WHERE abs(iy - mode) <= 2 GROUP BY bin)
    SELECT bin, round(a.mean, 4) AS mean, round(b.mean, 4) AS local FROM a JOIN b USING (bin)""")
def heatmap_expectation(spark, sf_dir):
    """Mean depth pixel of each time bin, over all pixels and around the largest."""
    s = _mp(R.spikes(spark, sf_dir)).where("my >= 0 and my < 320")
    d = s.groupBy(F.floor(F.col("t") / 100).alias("bin"), F.floor(F.col("my") / 10).alias("iy")).agg(F.sum("amp").alias("w"))
    a, b = volume.expectation(d, "bin", "iy", "w"), volume.expectation(d, "bin", "iy", "w", 2).withColumnRenamed("mean", "local")
    return a.join(b, "bin").select("bin", r4("mean").alias("mean"), r4("local").alias("local"))


@query(f"""WITH {REC}, k AS (SELECT spike_id, amp, spike_id % 108 AS k FROM train) SELECT k // 4 AS site, k % 4 AS profile, count(*) AS n, round(avg(amp), 4) AS amp, CASE k % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 10.0 WHEN 2 THEN 20.0 ELSE 40.0 END AS width FROM k GROUP BY ALL""")
def site_profile_join(spark, sf_dir):
    """Candidates k = site * profiles + profile taken apart and joined to the profile table."""
    profiles = spark.createDataFrame([(i, w) for i, w in enumerate((5.0, 10.0, 20.0, 40.0))], "profile long, width double")
    k = R.train(spark, sf_dir).select("amp", (F.col("spike_id") % 108).alias("k")).select("amp", F.expr("k div 4").alias("site"), (F.col("k") % 4).alias("profile"))
    j = k.join(F.broadcast(profiles), "profile")
    return j.groupBy("site", "profile", "width").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("amp")).alias("amp"))


@query("SELECT event_type AS tag, count(*) AS n, CAST(sum(CAST(coalesce(json_extract_string(props, '$.step'), json_extract_string(props, '$.iteration'), json_extract_string(props, '$.k')) AS BIGINT)) AS BIGINT) AS steps, count(*) FILTER (json_extract_string(props, '$.wall_s') IS NULL) AS without_time FROM events GROUP BY 1")
def json_schema_tolerance(spark, sf_dir):
    """Fields that go by several names in different files: the first that is there."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.from_json("props", "step long, iteration long, k long, wall_s double, wall_seconds double").alias("p"))
    step, wall = F.coalesce("p.step", "p.iteration", "p.k"), F.coalesce("p.wall_s", "p.wall_seconds")
    return e.groupBy(F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(step).alias("steps"), F.count_if(wall.isNull()).alias("without_time"))


@query(f"WITH {_PAIRS} SELECT t, count(*) AS n, round(sum(d), 4) AS d, round(avg(c), 4) AS c FROM hp GROUP BY t")
def pairs_roundtrip(spark, sf_dir):
    """Pairs checked, saved and loaded again, then summed by bin."""
    path = f"{shared_dir(spark)}/tidemark-pairs-{uuid.uuid4().hex}"
    state.save(motion.hard_pairs(_lagged(spark, sf_dir), 10.0), "pairs", path)
    return state.load(spark, "pairs", path).groupBy("t").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("d")).alias("d"), r4(F.avg("c")).alias("c"))


@query()
def sources_roundtrip(spark, sf_dir):
    """Sources of the pursuit with free shapes checked, saved and loaded again: sources and captured share by rank."""
    path = f"{shared_dir(spark)}/tidemark-sources-{uuid.uuid4().hex}"
    state.save(inference.sources(R.spikes(spark, sf_dir), free=True), "sources", path)
    g = state.load(spark, "sources", path).groupBy("rank")
    return g.agg(F.count(F.lit(1)).alias("n"), r4(F.try_divide(F.sum("captured"), F.sum("energy"))).alias("ve"))


@query()
def group_lasso_support(spark, sf_dir):
    """How many places the group lasso over all 27 keeps, by spike, with the share of energy that they capture."""
    s = R.spikes(spark, sf_dir)
    omega, shapes = inference.dct(4), inference.shapes_by_channel(spark)
    of, first = inference.by_geometry(shapes)

    def run(batches):
        for batch in batches:
            kind, y = of[batch.column(0).to_numpy()], inference.centred(batch.column(1))
            scale = np.sqrt(np.maximum(np.einsum("bct,bct->b", y, y), 1e-12))
            on, got = np.zeros(len(y), np.int64), np.zeros(len(y))
            for g in np.unique(kind):
                own = np.flatnonzero(kind == g)
                h = shapes[first[g]]
                u = np.matmul(h.T, (y[own] / scale[own, None, None]) @ omega.T)
                x = solvers.group_lasso_shared(h.T @ h, u, 0.1, 150)
                on[own] = (np.abs(x).max(2) > 1e-9).sum(1)
                got[own] = 2 * np.einsum("bnm,bnm->b", x, u) - np.einsum("bnm,bnm->b", x, np.matmul(h.T @ h, x))
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(got)], ["places", "share"])

    g = s.select("channel", "w").mapInArrow(run, "places long, share double").groupBy("places")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 3).alias("share"))


@query(f"""WITH {REC}, g AS (SELECT channel, count(*) AS n FROM train GROUP BY channel), r AS (SELECT channel, n, row_number() OVER (ORDER BY n DESC, channel) - 1 AS rank, count(*) OVER () AS m FROM g)
    SELECT channel, n, rank FROM r WHERE rank >= 4 AND rank < m - 4 AND (rank - 4) % 8 = 0""")
def usage_rank_interior(spark, sf_dir):
    """Channels by usage rank, without a margin at either end, evenly spaced. One row a channel meets in one task: 64."""
    from pyspark.sql import Window

    g = R.train(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    r = g.select("channel", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "channel")) - 1).cast("long").alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("m"))
    return r.where("rank >= 4 and rank < m - 4 and (rank - 4) % 8 = 0").select("channel", "n", "rank")


@query(f"WITH {REC}, {GEO}, {MP} SELECT CAST(floor(mx) AS BIGINT) AS ix, CAST(floor(my) AS BIGINT) AS iy, count(*) AS n, round(sum(amp), 4) AS amp FROM mp WHERE t >= 1200 AND t < 1300 AND mx >= 0 AND mx < 80 AND my >= 0 AND my < 320 GROUP BY ALL")
def centroid_panel(spark, sf_dir):
    """Centroids of a stretch of time on pixels of 1 um."""
    s = _mp(R.spikes(spark, sf_dir).where("t >= 1200 and t < 1300")).where("mx >= 0 and mx < 80 and my >= 0 and my < 320")
    return rasters.raster(s, {"ix": F.floor("mx"), "iy": F.floor("my")}, amp=F.col("amp")).select("ix", "iy", "n", r4("amp").alias("amp"))
