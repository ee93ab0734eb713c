"""Stream-stream interval joins: rows of two streams at most `lag` apart, with state that the watermarks bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_pairs(left: DataFrame, right: DataFrame, lag: str, late: str, key: str | None = None, bucket: int = 60) -> DataFrame:
    """left and right rows (id, ts, ...) with |left.ts - right.ts| <= lag: id, ts of both as l_id, l_ts, r_id, r_ts.

    Both watermarks trail their streams by `late`; a row is kept only while a partner can still come (lag + late after it). Rows meet
    on a time bucket of `bucket` seconds (and `key`, if given), each right row in its own and the two next to it, so the join
    is an equality with a residual condition and no task sees all of a moment's rows; lag must not pass the bucket.
    """
    cols = ["id", "ts"] + ([key] if key else [])
    at = F.floor(F.unix_timestamp("ts") / bucket)
    one = left.select(*cols).withWatermark("ts", late).select(F.col("id").alias("l_id"), F.col("ts").alias("l_ts"), at.alias("l_at"), *([F.col(key).alias("l_key")] if key else []))
    three = F.explode(F.array(at - 1, at, at + 1))
    two = right.select(*cols).withWatermark("ts", late).select(F.col("id").alias("r_id"), F.col("ts").alias("r_ts"), three.alias("r_at"), *([F.col(key).alias("r_key")] if key else []))
    on = (F.col("l_at") == F.col("r_at")) & F.expr(f"r_ts >= l_ts - interval {lag} and r_ts <= l_ts + interval {lag}")
    if key:
        on = on & (F.col("l_key") == F.col("r_key"))
    return one.join(two, on).select("l_id", "l_ts", "r_id", "r_ts")
