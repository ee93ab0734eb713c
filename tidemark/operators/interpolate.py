"""Linear interpolation joins: knots become segments, rows find theirs by an equality on a bucket of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(knots: DataFrame, t: str = "t", value: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """t0, p0, t1, p1 for each pair of neighbouring knots (of each key in by)."""
    w = Window.partitionBy(*by).orderBy(t)
    s = knots.select(*by, F.col(t).alias("t0"), F.col(value).alias("p0"), F.lead(t).over(w).alias("t1"), F.lead(value).over(w).alias("p1"))
    return s.where("t1 is not null")


def interpolated(rows: DataFrame, segs: DataFrame, bucket: float, out: str = "p", t: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with the value at their time, end values held outside the knots.

    A segment covers the buckets it touches, so the join is an equality on the bucket with a residual range condition; its
    rows grow with the data, not with rows times segments.
    """
    ends = segs.groupBy(*by).agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    held = F.least(F.greatest(F.col(t), F.col("lo")), F.col("hi"))
    keyed = (rows.join(F.broadcast(ends), list(by)) if by else rows.join(F.broadcast(ends))).withColumn("_at", held)
    keyed = keyed.withColumn("_bucket", F.floor(F.col("_at") / bucket)).drop("lo", "hi")
    cover = segs.join(F.broadcast(ends), list(by)) if by else segs.join(F.broadcast(ends))
    last = F.col("t1") == F.col("hi")
    cover = cover.select(*by, "t0", "p0", "t1", "p1", last.alias("_last"), F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.col("t1") / bucket))).alias("_bucket"))
    j = keyed.join(cover, [*by, "_bucket"]).where((F.col("_at") >= F.col("t0")) & ((F.col("_at") < F.col("t1")) | (F.col("_last") & (F.col("_at") <= F.col("t1")))))
    f = (F.col("_at") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return j.select(*rows.columns, (F.col("p0") + f * (F.col("p1") - F.col("p0"))).alias(out))


def at_depth(rows: DataFrame, motion: DataFrame, first: float, step: float, windows: int, bucket: float, y: str = "y", t: str = "t", out: str = "p") -> DataFrame:
    """rows with the motion at their time and depth, from a table (t, win, p) of depth windows with centres first + win * step.

    Linear in time inside the two windows that bracket the depth, then linear in depth; end values hold outside. The segments are
    equality-joined by window and bucket of time, and no row is shuffled to bring its two values together.
    """
    top = windows - 1
    place = F.least(F.greatest((F.col(y) - first) / step, F.lit(0.0)), F.lit(float(top)))
    low = F.least(F.floor(place), F.lit(max(top - 1, 0))).cast("int")
    segs = segments(motion, t, "p", ("win",))
    lower = interpolated(rows.withColumn("_place", place).withColumn("win", low), segs, bucket, "_low", t, ("win",))
    upper = lower.withColumn("win", F.least(F.col("win") + 1, F.lit(top)))
    both = interpolated(upper, segs, bucket, "_high", t, ("win",))
    share = F.col("_place") - F.floor(F.least("_place", F.lit(float(max(top - 1, 0)))))
    return both.select(*rows.columns, ((1 - share) * F.col("_low") + share * F.col("_high")).alias(out))
