"""Tables behind views: grouped orders, capped and quantised rows by atom, filters by depth and error, examples, fields over the probe."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.recording import channels


def grouped_offsets(rows: DataFrame, key: str) -> DataFrame:
    """key, n, start: where each key's rows begin in the stable order by key. The running sum is over keys, not rows."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, "n", (F.coalesce(F.sum("n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))


def grouped_rank(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `at`, their place in the stable order by key and then `order`: the key's start and the rank inside the key."""
    inside = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.join(grouped_offsets(rows, key), key).withColumn("at", F.col("start") + inside).drop("n", "start")


def spatial_rank(rows: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """rows with `rank` by y, then x, then all columns: for tables of the probe's size."""
    rest = [c for c in rows.columns if c not in (x, y)]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(y, x, *rest)) - 1)


def capped(rows: DataFrame, by: str, ident: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows of each group: those of the smallest hashes of their id, the same on every run. Groups are cut in each task's share
    before they meet, so a group of any size is bounded where it comes together."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(ident)), ident)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def quantised(value: Column, lo: float, hi: float, levels: int = 65_535) -> Column:
    """Whole numbers 0..levels over [lo, hi], clipped; null stays null."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo)))
    return F.when(value.isNotNull(), F.round(share * levels).cast("int"))


def packed_column(rows: DataFrame, by: str, ident: str, column: str) -> DataFrame:
    """by, n, data: the values (0..65535) of each group in the order of the id, as base64 of little-endian unsigned 16-bit numbers."""
    pair = F.concat(F.substring(F.lpad(F.hex(F.col("v")), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(F.col("v")), 4, "0"), 1, 2))
    cells = rows.select(by, F.col(ident).alias("i"), F.col(column).alias("v")).select(by, "i", pair.alias("h"))
    g = cells.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("c"))
    return g.select(by, F.size("c").alias("n"), F.translate(F.base64(F.unhex(F.array_join("c.h", ""))), "\r\n", "").alias("data"))


def atom_payload(sources: DataFrame, most: int, spans: dict[str, tuple[float, float]], by: str = "q", ident: str = "spike_id") -> DataFrame:
    """Of each atom at most `most` sources, with the columns of `spans` quantised: what a viewer of the atom is given."""
    c = capped(sources, by, ident, most)
    return c.select(by, ident, *[quantised(F.col(n), *s).alias(n) for n, s in spans.items()])


def in_view(rows: DataFrame, depth: tuple[float, float] | None = None, error: tuple[float, float] | None = None, most: int | None = None, ident: str = "spike_id", y: str = "y", e: str = "error") -> DataFrame:
    """Rows inside closed ranges of depth and error; with `most`, every so-manieth of them by hash, so that about `most` are left."""
    if depth:
        rows = rows.where(F.col(y).between(*depth))
    if error:
        rows = rows.where(F.col(e).between(*error))
    if most is None:
        return rows
    stride = max(1, -(-rows.count() // most))
    return rows.where(F.pmod(F.xxhash64(ident), F.lit(stride)) == 0)


def nearest_row(rows: DataFrame, x: float, y: float, ident: str = "spike_id", within: float | None = None) -> DataFrame:
    """The row nearest a point (ties to the smaller id), with its distance; none if it lies farther than `within`."""
    d = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
    out = rows.withColumn("distance", d).orderBy("distance", ident).limit(1)
    return out if within is None else out.where(F.col("distance") <= within)


def examples(spark: SparkSession, text: str | None, spikes: DataFrame, n: int, seed: int = 0, ident: str = "spike_id") -> DataFrame:
    """place, spike_id of the canonical examples: a JSON list of ids, or, without one, n spikes of the smallest hashes."""
    if text is not None:
        return spark.createDataFrame(list(enumerate(json.loads(text))), f"place int, {ident} long")
    some = spikes.select(ident).orderBy(F.xxhash64(F.lit(seed), F.col(ident)), ident).limit(n)
    return some.select((F.row_number().over(Window.orderBy(ident)) - 1).alias("place"), ident)


def covered(chosen: DataFrame, state: DataFrame, ident: str = "spike_id") -> DataFrame:
    """The state's rows of the examples, in their places; examples that the state lacks are an error that names some."""
    lacking = [r[0] for r in chosen.join(state.select(ident).distinct(), ident, "left_anti").orderBy("place").select(ident).limit(5).collect()]
    if lacking:
        raise ValueError(f"not in the state: {lacking}")
    return chosen.join(state, ident)


def field(spark: SparkSession, sources: DataFrame, kernel: str, a: float, b: float = 2.0, most: float = 200.0) -> DataFrame:
    """spike_id, channel, g: each source's footprint at all contacts within `most` um along the probe, not only its channel's neighbours;
    unit length over the contacts reached. The 64 contacts are broadcast."""
    from tidemark.functions.kernels import KERNELS

    c = F.broadcast(channels(spark).select(F.col("channel").alias("contact"), F.col("x").alias("cx"), F.col("y").alias("cy")))
    j = sources.select("spike_id", "px", "py", "pz").join(c, F.abs(F.col("cy") - F.col("py")) <= most)
    r2 = F.pow(F.col("cx") - F.col("px"), 2) + F.pow(F.col("cy") - F.col("py"), 2)
    g = j.select("spike_id", "contact", KERNELS[kernel](r2, F.col("pz") * F.col("pz"), a, b).alias("g"))
    size = g.groupBy("spike_id").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("size"))
    return g.join(size, "spike_id").select("spike_id", F.col("contact").alias("channel"), (F.col("g") / F.greatest("size", F.lit(1e-12))).alias("g"))


def soft_footprint(weights: np.ndarray, footprints: np.ndarray) -> np.ndarray:
    """Footprints of mixtures of candidates: weights (B, N) of sum 1 over footprints (C, N), of unit length."""
    g = weights @ footprints.T
    return g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)


def linspace(lo: float, hi: float, n: int) -> Column:
    """An array of n evenly spaced values, both ends among them."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + i * ((hi - lo) / max(n - 1, 1)))


def geomspace(lo: float, hi: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo * F.pow(F.lit(hi / lo), i / max(n - 1, 1)))


def jitter(ident: Column, seed: int, width: float) -> Column:
    """A value in [-width / 2, width / 2) that depends on the id and the seed alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 30)) / float(1 << 30) - 0.5) * width


def intensity(n: Column, scale: float = 1.8) -> Column:
    """Brightness 1 - exp(-n / scale) of a pixel that n events share."""
    return 1 - F.exp(-n / scale)


def above_floor(profile: Column) -> Column:
    """An array less its median, nothing below 0."""
    s = F.array_sort(profile)
    n = F.size(profile)
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2
    return F.transform(F.array(middle), lambda m: F.transform(profile, lambda v: F.greatest(v - m, F.lit(0.0))))[0]


def tree_fingerprint(rows: DataFrame, ident: str, fan: int = 4096) -> str:
    """SHA-256 of a table's content, whatever its partitions: hashes of rows by id are joined by thousands, level by level, so no group
    holds more than about `fan` hashes."""
    text = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    h = rows.select(F.col(ident).alias("i"), text.alias("h"))
    n = h.count()
    while n > 1:
        buckets = max(1, -(-n // fan))
        h = h.groupBy(F.pmod(F.xxhash64("i"), F.lit(buckets)).alias("i")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("i", "h")))["h"], ""), 256).alias("h"))
        n = buckets if buckets < n else 1
        if buckets == 1:
            break
    row = h.first()
    return row["h"] if row else ""
