"""Registered queries of codebook fits and refined places, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import codebook, inference, mixtures, packed, refine
from tidemark.operators.codebook import Config
from tidemark.plans.oracle import GEO, LAT, REC
from tidemark.queries import query
from tidemark.source_queries import _SMALL, SMALL
from tidemark.sources import recording as R

#: The best atom of each spike among places, shapes and lags of -1 to 1.
_ONE = """
    bk AS (SELECT m, lag, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM (SELECT m, lag, CASE lag WHEN 0 THEN o WHEN 1 THEN list_concat([0.0::DOUBLE], o[1:7]) ELSE list_concat(o[2:8], [0.0::DOUBLE]) END AS v FROM om, range(-1, 2) r(lag))),
    tc AS (SELECT spike_id, channel, m, lag, list_transform(range(8), lambda c: list_inner_product(zw[c * 8 + 1 : c * 8 + 8], v)) AS c FROM z, bk),
    ax AS (SELECT spike_id, tc.channel, n, m, lag, list_inner_product(g, c) AS x FROM tc JOIN fp ON fp.channel = tc.channel),
    b1 AS (SELECT * FROM ax QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY greatest(x, 0) DESC, n, m, lag) = 1),
    un AS (SELECT b1.spike_id, m, lag, greatest(b1.x, 0) / (1 + 1e-9) AS a, list_transform(range(1, 9), lambda t: list_sum(list_transform(range(8), lambda c: g[c + 1] * zw[c * 8 + t]))) AS y
        FROM b1 JOIN fp ON fp.channel = b1.channel AND fp.n = b1.n JOIN z ON z.spike_id = b1.spike_id)"""


@query(f"""WITH {REC}, {GEO}, {LAT}, {_ONE}, al AS (SELECT m - 1 AS q, t, CASE WHEN t + lag BETWEEN 0 AND 7 THEN a * y[t + lag + 1] ELSE 0 END AS v, a FROM un, range(8) r(t))
    SELECT q, t, round(sum(v), 2) AS total, round(sum(a), 2) AS weight FROM al GROUP BY q, t""")
def aligned_atoms(spark, sf_dir):
    """What a codebook update sums for each atom: waveforms under the best places by amplitude, with lags taken back."""
    c = Config(sources=1, prototypes=0)
    s = codebook.passed(R.spikes(spark, sf_dir), inference.dct(4), c, inference.shapes_by_channel(spark))
    rows = [(q, t, float(s.atoms[q, t]), float(s.weight[q])) for q in range(4) for t in range(8) if s.weight[q] > 0]
    return spark.createDataFrame(rows, "q long, t long, v double, a double").select("q", "t", F.round("v", 2).alias("total"), F.round("a", 2).alias("weight"))


def _used(spikes, book):
    """Sources by atom and lag under a fitted codebook, with the share of all energy that it captures."""
    s = codebook.explained(spikes, book)
    g = s.groupBy("q", "lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("amp")), 4).alias("amp"), F.sum(F.when(F.col("rank") == 0, F.col("captured"))).alias("got"), F.sum(F.when(F.col("rank") == 0, F.col("energy"))).alias("energy"))
    return g.select("q", "lag", "n", "amp", F.round(F.try_divide("got", "energy"), 5).alias("ve"))


@query()
def codebook_procrustes(spark, sf_dir):
    """Two sources a spike, three orthonormal atoms at lags of -1 to 1, fitted by Procrustes steps."""
    s = R.spikes(spark, sf_dir)
    return _used(s, codebook.fitted(s, Config(sources=2, shapes=3, prototypes=0, orthonormal=True, rounds=4)))


@query()
def codebook_cones(spark, sf_dir):
    """Two sources a spike, four atoms in cones of 35 degrees around two prototypes of opposite polarity."""
    s = R.spikes(spark, sf_dir)
    return _used(s, codebook.fitted(s, Config(sources=2, shapes=4, prototypes=2, rounds=4)))


@query()
def codebook_free(spark, sf_dir):
    """Two sources a spike with free coefficients of three orthonormal shapes."""
    s = R.spikes(spark, sf_dir)
    return _used(s, codebook.fitted(s, Config(sources=2, shapes=3, shape="free", rounds=4)))


@query(f"""WITH {REC}, {GEO}, {LAT}, {_SMALL},
    s AS (SELECT spike_id, any_value(pj.channel) AS channel, site, profile, sum(list_inner_product(g, p) ** 2) / 1.000001 AS score, any_value(energy) AS energy FROM pj JOIN cg ON pj.channel = cg.channel GROUP BY spike_id, site, profile),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY round(score, 9) DESC, site, profile) = 1),
    f AS (SELECT spike_id, sum(list_inner_product(p, p)) / 1.000001 AS diagonal, sum(list_sum(p) ** 2) / 1.000001 AS every FROM pj GROUP BY spike_id)
    SELECT site * 4 + profile AS k, cfg, count(*) AS n, round(sum(energy), 3) AS energy, round(sum(score), 3) AS captured, round(sum(diagonal), 3) AS diagonal, round(sum(every), 3) AS every
    FROM b JOIN geo USING (channel) JOIN f USING (spike_id) GROUP BY ALL""")
def site_statistics(spark, sf_dir):
    """Sums of packed forms by candidate and geometry: all that refining a candidate needs of its spikes."""
    s = refine.statistics(R.spikes(spark, sf_dir), inference.dct(4), SMALL)
    i, j, w = packed.triangle(8)
    on = F.aggregate(F.zip_with("p", F.array(*[F.lit(float(a == b)) for a, b in zip(i, j)]), lambda p, d: p * d), F.lit(0.0), lambda a, x: a + x)
    every = F.aggregate(F.zip_with("p", F.array(*[F.lit(float(v)) for v in w]), lambda p, d: p * d), F.lit(0.0), lambda a, x: a + x)
    return s.select("k", "cfg", "n", F.round("energy", 3).alias("energy"), F.round("captured", 3).alias("captured"), F.round(on, 3).alias("diagonal"), F.round(every, 3).alias("every"))


@query()
def refined_places(spark, sf_dir):
    """Places and widths of 27 candidates climbed once at fixed assignments: what each captures before and after."""
    start = refine.Learned(refine.start_places(None, 27), np.full(27, 20.0))
    r = refine.refined(refine.statistics(R.spikes(spark, sf_dir), inference.dct(4), start), start)
    return r.select("k", "n", *[F.round(c, 2).alias(c) for c in ("x", "y", "z", "width")], F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))


@query()
def learned_basis(spark, sf_dir):
    """Assignment and refinement in turn from k-means places; spikes by learned candidate."""
    s = R.spikes(spark, sf_dir)
    start = refine.Learned(refine.start_places(s, 12, "kmeans"), np.full(12, 20.0))
    basis, _ = refine.fitted(s, inference.dct(4), start, rounds=3)
    a = packed.assigned(packed.forms(s, inference.dct(4)), basis)
    return a.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score") / F.sum("energy"), 5).alias("ve"))


def _mixture() -> mixtures.Mixture:
    return mixtures.Mixture(refine.start_places(None, 12), np.full(12, 25.0), inference.dct(3))


def _places(d):
    g = d.groupBy("places").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sse") / F.sum("energy"), 4).alias("nmse"), F.round(F.avg("entropy"), 3).alias("entropy"), F.max("off").alias("off"))
    return g.select("places", "n", "nmse", "entropy", (F.col("off") < 1e-6).alias("optimal"))


@query()
def mixture_grid(spark, sf_dir):
    """Non-negative mixtures of 12 places and 3 shapes: spikes by places in use, with a check of optimality."""
    return _places(mixtures.solved(R.spikes(spark, sf_dir), _mixture()))


@query()
def mixture_entropy(spark, sf_dir):
    """The same with an entropy term on the places' shares (its optimum isn't the plain one)."""
    return _places(mixtures.solved(R.spikes(spark, sf_dir), _mixture(), 0.5)).drop("optimal")


@query()
def mixture_fit(spark, sf_dir):
    """Places, widths and shapes of the mixture fitted to all spikes until it has converged; energy left by channel."""
    s = R.spikes(spark, sf_dir)
    model, _ = mixtures.fitted(s, _mixture())
    return mixtures.solved(s, model).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sse") / F.sum("energy"), 3).alias("nmse"))
