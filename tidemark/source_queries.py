"""Registered queries of beam inference, candidate dictionaries and packed assignment, with their DuckDB SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.operators import beam, inference, packed
from tidemark.operators.candidates import Candidates, grid, lattice, profiles
from tidemark.plans.oracle import GEO, LAT, REC
from tidemark.queries import query
from tidemark.sources import recording as R

#: u: what each place takes of each shape, as a list; s: its square.
U = """u AS (SELECT *, list_inner_product(u, u) AS s FROM (
        SELECT pj.spike_id, pj.channel, fp.n, any_value(fp.g) AS g, any_value(fp.px) AS px, any_value(fp.py) AS py, any_value(fp.pz) AS pz,
            list(list_sum(list_transform(range(1, 9), lambda c: fp.g[c] * pj.p[c])) ORDER BY m) AS u FROM pj JOIN fp ON fp.channel = pj.channel GROUP BY pj.spike_id, pj.channel, fp.n)),
    f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY round(s, 9) DESC, n) <= 8)"""


def by_support(sources):
    """channel, support: spikes, captured, mean share of the weakest source, mean of what leaving it out loses."""
    s = sources.groupBy("spike_id", "channel", "support").agg(F.max("captured").alias("captured"), F.min("share").alias("weak"), F.sum("leaveout").alias("out"))
    g = s.groupBy("channel", "support").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("captured"), 3).alias("captured"), F.round(F.avg("weak"), 5).alias("weak"), F.round(F.avg("out"), 2).alias("leaveout"))
    return g.select("channel", F.col("support").cast("long").alias("support"), "n", "captured", "weak", "leaveout")


@query(f"""WITH {REC}, {GEO}, {LAT}, {U},
    p AS (SELECT a.spike_id, a.channel, least(a.n, b.n) AS n1, greatest(a.n, b.n) AS n2, a.s AS s1, b.s AS s2, list_inner_product(a.g, b.g) AS c, list_inner_product(a.u, b.u) AS x
        FROM f a JOIN u b ON a.spike_id = b.spike_id AND a.n <> b.n WHERE (a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2 >= 16),
    q AS (SELECT *, (s1 + s2 - 2 * c * x) / (1 - c * c) AS got, sqrt(greatest(s1 + c * c * s2 - 2 * c * x, 0)) / (1 - c * c) AS b1, sqrt(greatest(s2 + c * c * s1 - 2 * c * x, 0)) / (1 - c * c) AS b2
        FROM p WHERE (1 + abs(c)) / (1 - abs(c)) <= 10000 QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY round(got, 9) DESC, n1, n2) = 1),
    one AS (SELECT spike_id, channel, max(s) AS s FROM u GROUP BY ALL),
    r AS (SELECT one.*, q.*, q.got - one.s > 0.5 AND least(b1, b2) / (b1 + b2) >= 0.02 AS two FROM one LEFT JOIN q USING (spike_id))
    SELECT channel, CASE WHEN two THEN 2 ELSE 1 END AS support, count(*) AS n, round(sum(CASE WHEN two THEN got ELSE s END), 3) AS captured,
        round(avg(CASE WHEN two THEN least(b1, b2) / (b1 + b2) ELSE 1 END), 5) AS weak, round(avg(CASE WHEN two THEN b1 * b1 + b2 * b2 ELSE s END), 2) AS leaveout FROM r GROUP BY ALL""")
def beam_pairs(spark, sf_dir):
    """Two sources with free shapes: a beam of 8 firsts against every second, taken where the gain passes 0.5."""
    return by_support(beam.sources(R.spikes(spark, sf_dir), "m2_r2", options=beam.Options(beam=8, min_gain=0.5)))


@query()
def beam_triples(spark, sf_dir):
    """Up to three sources with free shapes, grown from 8 partial supports."""
    return by_support(beam.sources(R.spikes(spark, sf_dir), "m2_r3", options=beam.Options(beam=8, min_gain=0.5)))


@query()
def beam_shared_triples(spark, sf_dir):
    """Up to three sources of one shared shape at exact weights, grown from 4 partial supports over 8 places."""
    return by_support(beam.sources(R.spikes(spark, sf_dir), "m1_r3", options=beam.Options(beam=4, shortlist=8, min_gain=0.5)))


@query()
def beam_models(spark, sf_dir):
    """What every model captures of all spikes, with its mean number of sources."""
    s = R.spikes(spark, sf_dir)
    each = []
    for name in beam.MODELS:
        one = beam.sources(s, name, options=beam.Options(beam=4, shortlist=6, min_gain=0.5)).where("rank = 0")
        each.append(one.groupBy(F.lit(name).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("support"), 4).alias("support"), F.round(F.sum("captured") / F.sum("energy"), 6).alias("ve"), F.count_if("searched").alias("searched")))
    return functools.reduce(lambda a, b: a.unionByName(b), each)


#: Sites and profiles of the small dictionary.
SMALL = Candidates(grid(3, 3, 3), [("monopole", 10.0, 2.0), ("monopole", 40.0, 2.0), ("exp", 25.0, 2.0), ("lorentz", 30.0, 2.0)])
_SMALL = """
    si AS (SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS site, x, y, z FROM (VALUES (-90.0::DOUBLE), (0.0), (90.0)) a(x), (VALUES (-60.0::DOUBLE), (0.0), (60.0)) b(y), (VALUES (4.0::DOUBLE), (sqrt(512.0)), (128.0)) c(z)),
    ck AS (SELECT channel, site, profile, list_transform(range(1, 9), lambda i: CASE profile WHEN 0 THEN 10.0 / sqrt((dx[i] - si.x) ** 2 + (dy[i] - si.y) ** 2 + z * z + 100.0) WHEN 1 THEN 40.0 / sqrt((dx[i] - si.x) ** 2 + (dy[i] - si.y) ** 2 + z * z + 1600.0)
        WHEN 2 THEN exp(-sqrt((dx[i] - si.x) ** 2 + (dy[i] - si.y) ** 2 + z * z) / 25.0) ELSE 900.0 / ((dx[i] - si.x) ** 2 + (dy[i] - si.y) ** 2 + z * z + 900.0) END) AS g FROM geo, si, range(4) r(profile)),
    cg AS (SELECT channel, site, profile, list_transform(g, lambda v: v / greatest(sqrt(list_inner_product(g, g)), 1e-12)) AS g FROM ck)"""


@query(f"""WITH {REC}, {GEO}, {LAT}, {_SMALL},
    s AS (SELECT spike_id, site, profile, sum(list_inner_product(g, p) ** 2) / 1.000001 AS score, any_value(energy) AS energy FROM pj JOIN cg ON pj.channel = cg.channel GROUP BY spike_id, site, profile),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY round(score, 9) DESC, site, profile) = 1)
    SELECT site, profile, count(*) AS n, round(sum(score), 3) AS captured, round(sum(energy - score), 3) AS sse FROM b GROUP BY ALL""")
def packed_assign(spark, sf_dir):
    """One source a spike out of 27 sites x 4 profiles, scored on packed forms."""
    a = packed.assigned(packed.forms(R.spikes(spark, sf_dir), inference.dct(4)), SMALL)
    return a.groupBy("site", F.col("profile").cast("long").alias("profile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("captured"), F.round(F.sum(F.col("energy") - F.col("score")), 3).alias("sse"))


@query(f"""WITH {REC}, {GEO}, {LAT}, p AS (SELECT spike_id, i, j, sum(p[i] * p[j]) / 1.000001 AS p FROM pj, range(1, 9) a(i), range(1, 9) b(j) WHERE i <= j GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY i, j) - 1 AS entry, round(sum(p), 3) AS total, round(max(p), 4) AS most FROM p GROUP BY i, j""")
def packed_forms(spark, sf_dir):
    """Packed forms by entry, rows of the upper triangle one after another."""
    p = packed.forms(R.spikes(spark, sf_dir), inference.dct(4)).select(F.posexplode("p").alias("entry", "p"))
    return p.groupBy(F.col("entry").cast("long").alias("entry")).agg(F.round(F.sum("p"), 3).alias("total"), F.round(F.max("p"), 4).alias("most"))


@query()
def lattice_assign(spark, sf_dir):
    """One source a spike out of 16 ** 3 sites x 4 profiles: spikes, captured share and mean depth by profile."""
    wide = Candidates(lattice(16), profiles(["monopole", "gauss"], 2, lo=10.0, hi=40.0))
    a = packed.assigned(packed.forms(R.spikes(spark, sf_dir), inference.dct(4)), wide)
    sites = spark.createDataFrame([(i, float(s[2])) for i, s in enumerate(wide.sites)], "site long, z double")
    g = a.join(sites, "site").groupBy(F.col("profile").cast("long").alias("profile"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("used"), F.round(F.sum("score") / F.sum("energy"), 5).alias("ve"), F.round(F.avg("z"), 3).alias("z"))


@query(f"""WITH {REC}, w AS (SELECT i, 512.0::DOUBLE ** (i / 4.0) AS w FROM range(5) r(i)),
    pr AS (SELECT row_number() OVER (ORDER BY o, a, b) - 1 AS profile, kernel, a, b FROM (SELECT 0 AS o, 'gauss' AS kernel, w AS a, 2.0::DOUBLE AS b FROM w UNION ALL
        SELECT 1, 'power', w, b FROM w, (VALUES (1.0::DOUBLE), (3.0)) v(b) UNION ALL SELECT 2, 'gauss_aniso', x.w, y.w FROM w x, w y)),
    ax AS (SELECT i, -150 + 100.0 * i AS xy, 300.0::DOUBLE ** (i / 3.0) AS z FROM range(4) r(i)),
    k AS (SELECT (x.i * 16 + y.i * 4 + z.i) * 40 + profile AS k, profile, kernel, a, b, x.xy AS x, y.xy AS y, z.z FROM ax x, ax y, ax z, pr),
    m AS (SELECT k, (k.k * 7919) % (SELECT count(*) FROM train) AS r, profile, kernel, a, b, x, y, z FROM k),
    t AS (SELECT spike_id % 2560 AS k, count(*) AS spikes FROM train GROUP BY ALL)
    SELECT profile, kernel, round(a, 6) AS a, round(b, 6) AS b, count(*) AS n, round(sum(m.z), 4) AS z, round(sum(x + 2 * y), 4) AS xy, CAST(coalesce(sum(spikes), 0) AS BIGINT) AS spikes FROM m LEFT JOIN t USING (k) GROUP BY ALL""")
def candidate_table(spark, sf_dir):
    """The dictionary of 4 ** 3 sites and 40 profiles as a table (candidate = site x profiles + profile), met by spikes on the candidate."""
    c = Candidates(lattice(4), profiles(["gauss", "power", "gauss_aniso"], 5, shapes=(1.0, 3.0))).table(spark)
    t = R.train(spark, sf_dir).groupBy((F.col("spike_id") % 2560).alias("k")).agg(F.count(F.lit(1)).alias("spikes"))
    g = c.join(t, "k", "left").groupBy("profile", "kernel", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("z"), F.round(F.sum(F.col("x") + 2 * F.col("y")), 4).alias("xy"), F.coalesce(F.sum("spikes"), F.lit(0)).alias("spikes"))
