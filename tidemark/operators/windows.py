"""Ranking and running operators. Windows are partitioned by a key wherever the operator has one, else they run over sums of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_equalized(df: DataFrame, by: list[str], value: str, ident: str, out: str = "rank01") -> DataFrame:
    """Rank of value in its group, scaled to [0, 1]; ties by id; single rows 0."""
    w = Window.partitionBy(*by).orderBy(value, ident)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(out, (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1)))


def concentration(counts: DataFrame, key: str, weight: str, chunk: int = 65536) -> DataFrame:
    """rank, cumulative share of the groups in descending order of weight (ties by key, null first). counts has one row a group; keys
    and weights are integers.

    Ranks add up from three levels: the groups of larger weight, the chunks of smaller keys of the same weight, and the keys of a
    chunk. Only the table of distinct weights is ordered as a whole; weights that count rows have at most sqrt(2 * rows) values.
    """
    # null keys come first: a chunk below that of any long
    c = counts.select(key, weight, F.coalesce(F.floor(F.col(key) / chunk), F.lit(-(1 << 62))).alias("_c"))
    per = c.groupBy(weight, "_c").agg(F.count(F.lit(1)).alias("_m"))
    per = per.select(weight, "_c", (F.sum("_m").over(Window.partitionBy(weight).orderBy("_c")) - F.col("_m")).alias("_before"))
    whole = c.groupBy(weight).agg(F.count(F.lit(1)).alias("_m")).withColumn("_s", F.col("_m") * F.col(weight))
    larger = Window.orderBy(F.desc(weight))
    whole = whole.select(weight, *[(F.sum(x).over(larger) - F.col(x)).alias(y) for x, y in (("_m", "_rows"), ("_s", "_mass"))], F.sum("_s").over(Window.partitionBy()).alias("_total"))
    inside = F.row_number().over(Window.partitionBy(weight, "_c").orderBy(key))
    equal = c.withColumn("_i", inside).join(per, [weight, "_c"]).withColumn("_i", F.col("_i") + F.col("_before")).join(whole, weight)
    return equal.select(key, weight, (F.col("_rows") + F.col("_i")).alias("rank"), ((F.col("_mass") + F.col("_i") * F.col(weight)) / F.col("_total")).alias("share"))


def sample_per_group(df: DataFrame, by: str, ident: str, n: int, multiplier: int = 7919, modulus: int = 10007) -> DataFrame:
    """At most n rows a group, in the order of a portable integer hash of the id (the sampling operator's cap)."""
    h = (F.col(ident) * multiplier + 104729) % modulus
    w = Window.partitionBy(by).orderBy(h, ident)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def runs(keys: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Gaps and islands: first, last and length of each run of consecutive integers; keys are distinct."""
    w = Window.partitionBy(*by).orderBy(key)
    g = keys.select(*by, key, (F.col(key) - F.row_number().over(w)).alias("_g"))
    return g.groupBy(*by, "_g").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def every(keys: DataFrame, key: str, stride: int, chunk: int = 65536) -> DataFrame:
    """Every stride-th of the distinct keys in order; keys are distinct integers. Only one count for a range of chunk keys is summed
    as a whole."""
    c = keys.withColumn("_c", F.floor(F.col(key) / chunk))
    per = c.groupBy("_c").agg(F.count(F.lit(1)).alias("_m"))
    per = per.select("_c", (F.sum("_m").over(Window.orderBy("_c")) - F.col("_m")).alias("_before"))
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy(key)) - 1).join(per, "_c")
    return c.where((F.col("_before") + F.col("_r")) % stride == 0).select(*keys.columns)


def overlapping_blocks(y: Column, step: float, half: float) -> Column:
    """Ids of all blocks with centres at multiples of step that lie within half of y."""
    return F.explode(F.sequence(F.ceil((y - half) / step), F.floor((y + half) / step)))


def blend_weight(y: Column, block: Column, step: float, half: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(y - block * step) / half) + 1e-3


def differences(rows: DataFrame, by: str, order: str, value: str, bucket: int) -> DataFrame:
    """by, order, diff: each value less the one before it in its group, null for the first. Groups are cut into buckets of the (whole-number,
    unique) order, so a group of any size spreads over tasks; a bucket's first row takes the last value of the bucket before it, from a
    table of one row a bucket."""
    d = rows.select(by, order, value, F.floor(F.col(order) / bucket).alias("_bucket"))
    inside = F.lag(value).over(Window.partitionBy(by, "_bucket").orderBy(order))
    first = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(order)) == 1
    last = d.groupBy(by, "_bucket").agg(F.max_by(value, order).alias("_last"))
    last = last.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), F.lag("_last").over(Window.partitionBy(by).orderBy("_bucket")).alias("_before"))
    d = d.withColumn("_inside", inside).withColumn("_first", first)
    j = d.join(last, d[by].eqNullSafe(last["_by"]) & d["_bucket"].eqNullSafe(last["_b"]), "left")
    return j.select(d[by], d[order], (F.col(value) - F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_inside"))).alias("diff"))
