"""Registered queries of saved fits, the run index and the tables behind views, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.operators import inference, runs, views
from tidemark.plans.oracle import GEO, LAT, REC
from tidemark.queries import MP, _mp, query
from tidemark.session import shared_dir
from tidemark.source_queries import _SMALL, SMALL
from tidemark.sources import fits
from tidemark.sources import recording as R

_BEST = f"""{REC}, {GEO}, {LAT}, {_SMALL},
    s AS (SELECT spike_id, any_value(pj.channel) AS channel, site, profile, sum(list_inner_product(g, p) ** 2) AS score, any_value(energy) AS energy FROM pj JOIN cg ON pj.channel = cg.channel GROUP BY spike_id, site, profile),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY round(score / 1.000001, 9) DESC, site, profile) = 1)"""


def _saved(spark, sf_dir) -> tuple[str, str]:
    """A folder with one fit, saved twice (the second time nothing is written), and the fit's name."""
    root = f"{shared_dir(spark)}/tidemark-fits-{uuid.uuid4().hex}"
    fit = fits.Fit(SMALL, inference.dct(4))
    fit.assignments = fits.assigned(R.spikes(spark, sf_dir), fit)
    for _ in range(2):
        fits.save(spark, f"{root}/small", fit, {"kernel": "mixed", "M": "4"}, [{"iteration": 0, "objective": 0.9, "wall_s": 1.5}, {"step": 1, "nmse": 0.8}])
    return root, "small"


@query(f"""WITH {_BEST}, m AS (SELECT quantile_disc(sqrt(score), 0.5) AS m FROM b)
    SELECT site, profile, count(*) AS n, round(sum(sqrt(score) / m * 100), 2) AS amp, round(sum(x), 2) AS x, round(sum(z), 2) AS z FROM b JOIN si USING (site), m GROUP BY ALL""")
def fit_roundtrip(spark, sf_dir):
    """A whole fit saved, loaded, rescaled to a median amplitude of 100 and placed: sums by candidate."""
    root, name = _saved(spark, sf_dir)
    fit = fits.load(spark, f"{root}/{name}")
    a = fits.placed(fits.rescaled(fit.assignments), fit)
    p = len(fit.candidates.profiles)
    g = a.groupBy(F.expr(f"k div {p}").alias("site"), (F.col("k") % p).alias("profile"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amp"), 2).alias("amp"), F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("z"), 2).alias("z"))


@query(f"""WITH {_BEST} SELECT 'small' AS run, '4' AS m, CAST(27 AS BIGINT) AS K, CAST(108 AS BIGINT) AS KS, count(*) AS spikes, count(DISTINCT site * 4 + profile) AS cands_used, count(DISTINCT site) AS sites_used,
    round(sum(energy - score / 1.000001), 2) AS sse, CAST(2 AS BIGINT) AS steps, 0.9::DOUBLE AS first, 0.8::DOUBLE AS last, false AS rose FROM b""")
def run_index(spark, sf_dir):
    """The index over a folder of fits: summary and convergence by run, filtered and sorted."""
    root, _ = _saved(spark, sf_dir)
    i = runs.ordered(runs.filtered(runs.index(spark, root), {"learned": False}, ["sse"]), "sse")
    return i.select("run", F.col("config")["M"].alias("m"), "K", "KS", "spikes", "cands_used", "sites_used", F.round("sse", 2).alias("sse"), "steps", "first", "last", "rose")


@query(f"WITH {REC}, r AS (SELECT channel, row_number() OVER (ORDER BY channel, spike_id) - 1 AS spot FROM train) SELECT channel, count(*) AS n, min(spot) AS start, CAST(sum(spot) AS BIGINT) AS total FROM r GROUP BY channel")
def grouped_order(spark, sf_dir):
    """Spikes in the stable order by channel: where each channel begins, and the sum of its places."""
    r = views.grouped_rank(R.train(spark, sf_dir).select("channel", "spike_id"), "channel", ["spike_id"])
    return r.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"), F.sum("at").alias("total"))


@query(f"WITH {REC}, {GEO} SELECT channel, row_number() OVER (ORDER BY y, x, channel) - 1 AS rank, count(spike_id) AS n FROM ch LEFT JOIN train USING (channel) GROUP BY channel, x, y")
def spatial_order(spark, sf_dir):
    """Contacts by depth and then across, with their spikes."""
    n = R.train(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    c = views.spatial_rank(R.channels(spark))
    return c.join(n, "channel", "left").select("channel", F.col("rank").cast("long").alias("rank"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {REC}, {GEO}, {MP} SELECT kind, count(*) AS n, round(min(my), 4) AS lo, round(max(my), 4) AS hi FROM mp WHERE my BETWEEN 60 AND 180 AND amp BETWEEN 5 AND 50 GROUP BY kind")
def view_filter(spark, sf_dir):
    """Spikes inside closed ranges of depth and amplitude."""
    v = views.in_view(_mp(R.spikes(spark, sf_dir)), (60.0, 180.0), (5.0, 50.0), y="my", e="amp")
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("my"), 4).alias("lo"), F.round(F.max("my"), 4).alias("hi"))


@query(f"WITH {REC}, {GEO}, {MP} SELECT spike_id, round(sqrt((mx - 33) ** 2 + (my - 141) ** 2), 4) AS distance FROM mp ORDER BY sqrt((mx - 33) ** 2 + (my - 141) ** 2), spike_id LIMIT 1")
def nearest_spike(spark, sf_dir):
    """The spike nearest a point of the view."""
    s = _mp(R.spikes(spark, sf_dir)).select("spike_id", F.col("mx").alias("x"), F.col("my").alias("y"))
    return views.nearest_row(s, 33.0, 141.0).select("spike_id", F.round("distance", 4).alias("distance"))


@query(f"""WITH {REC}, q AS (SELECT channel, spike_id, CAST(round(greatest(0, least(1, t / 2000)) * 65535) AS INT) AS v FROM train), h AS (SELECT channel, spike_id, format('{{:04X}}', v) AS x FROM q)
    SELECT channel, CAST(count(*) AS INT) AS n, base64(unhex(string_agg(x[3:4] || x[1:2], '' ORDER BY spike_id))) AS data FROM h GROUP BY channel""")
def payload_base64(spark, sf_dir):
    """Times of each channel's spikes as base64 of 16-bit numbers."""
    s = R.train(spark, sf_dir).select("channel", "spike_id", views.quantised(F.col("t"), 0.0, 2000.0).alias("v"))
    return views.packed_column(s, "channel", "spike_id", "v")


@query()
def atom_payload(spark, sf_dir):
    """Of each shape's sources at most 200, with time, amplitude and energy share quantised."""
    s = inference.sources(R.spikes(spark, sf_dir), r=2).withColumn("share", F.try_divide("captured", "energy"))
    return views.atom_payload(s, 200, {"t": (0.0, 2000.0), "amp": (0.0, 20.0), "share": (0.0, 1.0)})


@query(f"""WITH {REC}, {GEO}, {LAT}, g AS (SELECT spike_id, ch.channel, 15.0 / sqrt((ch.x - px) ** 2 + (ch.y - py) ** 2 + pz * pz + 225.0) AS g FROM loc JOIN ch ON abs(ch.y - py) <= 100),
    u AS (SELECT *, g / sqrt(sum(g * g) OVER (PARTITION BY spike_id)) AS u FROM g) SELECT channel, count(*) AS n, round(sum(u), 3) AS total, round(max(u), 5) AS most FROM u GROUP BY channel""")
def probe_field(spark, sf_dir):
    """Each spike's source seen at all contacts within 100 um along the probe."""
    f = views.field(spark, inference.located(R.spikes(spark, sf_dir)), "monopole", 15.0, most=100.0)
    return f.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("g"), 3).alias("total"), F.round(F.max("g"), 5).alias("most"))


@query(f"""WITH {REC}, a AS (SELECT channel, list_transform(ptp, lambda v: greatest(v - list_median(ptp), 0)) AS p FROM z)
    SELECT channel, slot, round(avg(p[slot + 1]), 4) AS mean FROM a, range(8) r(slot) GROUP BY ALL""")
def ptp_profile(spark, sf_dir):
    """Mean peak-to-peak by slot above each spike's own median."""
    p = R.spikes(spark, sf_dir).select("channel", views.above_floor(A.peak_to_peak(F.col("w"), 8, 8)).alias("p"))
    p = p.select("channel", F.posexplode("p").alias("slot", "v"))
    return p.groupBy("channel", F.col("slot").cast("long").alias("slot")).agg(F.round(F.avg("v"), 4).alias("mean"))


@query(f"""WITH {REC}, c20 AS (SELECT channel, CAST(floor(t / 20) AS BIGINT) AS bin, count(*) AS n FROM train GROUP BY ALL)
    SELECT bin, round(sum(1 - exp(-n / 1.8)), 5) AS light, round(-20 + (bin % 5) * 10.0, 5) AS even, round(2 * 8.0 ** ((bin % 4) / 3.0), 5) AS geometric FROM c20 GROUP BY bin""")
def view_scales(spark, sf_dir):
    """Brightness of pixels by time bin, beside evenly and geometrically spaced levels."""
    n = R.train(spark, sf_dir).groupBy("channel", F.floor(F.col("t") / 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    even, geometric = views.linspace(-20.0, 20.0, 5), views.geomspace(2.0, 16.0, 4)
    g = n.groupBy("bin").agg(F.round(F.sum(views.intensity(F.col("n"))), 5).alias("light"))
    return g.select("bin", "light", F.round(F.get(even, (F.col("bin") % 5).cast("int")), 5).alias("even"), F.round(F.get(geometric, (F.col("bin") % 4).cast("int")), 5).alias("geometric"))
