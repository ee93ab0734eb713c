"""Registered queries of raw recordings, snapshot tables and stream-stream joins, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.snapshots import Table
from tidemark.plans.oracle import REC
from tidemark.queries import query
from tidemark.session import shared_dir
from tidemark.sources import raw
from tidemark.sources import recording as R
from tidemark.streaming.joins import interval_pairs

#: Samples a second and samples of the recording that the raw queries write.
RATE, SAMPLES = 100, 195_900


def _recorded(spark, sf_dir) -> str:
    """All spikes as a raw recording of 64 channels, each at its sample with ten times its amplitude, in files of 10 s; its folder."""
    path = f"{shared_dir(spark)}/tidemark-raw-{uuid.uuid4().hex}"
    points = R.train(spark, sf_dir).select(F.expr(f"sample div {R.FS // RATE}").alias("sample"), "channel", F.round(F.col("amp") * 10).alias("value"))
    raw.written(points, path, R.CHANNELS, SAMPLES, 10 * RATE).agg(F.sum("samples")).first()
    raw.register(spark)
    return path


def _raw(spark, path, **options):
    r = spark.read.format("tidemark_raw").options(path=path, channels=R.CHANNELS, rate=RATE, window=7777, cutoff=10.0, **options)
    return r.load().select("sample", F.posexplode("v").alias("channel", "v"))


@query(f"""WITH {REC}, p AS (SELECT sample // 300 AS sample, channel, sum(round(amp * 10)) AS v FROM train GROUP BY ALL)
    SELECT CAST(channel AS BIGINT) AS channel, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (sample % 1000)) AS BIGINT) AS moment, count(*) FILTER (v <> 0) AS points, CAST({SAMPLES} AS BIGINT) AS samples FROM p GROUP BY channel""")
def raw_roundtrip(spark, sf_dir):
    """A raw recording written and read back unfiltered: sums and moments by channel."""
    g = _raw(spark, _recorded(spark, sf_dir), filter="false", reference="false").groupBy(F.col("channel").cast("long").alias("channel"))
    v = F.col("v").cast("long")
    return g.agg(F.sum(v).alias("total"), F.sum(v * (F.col("sample") % 1000)).alias("moment"), F.count_if(v != 0).alias("points"), F.count(F.lit(1)).alias("samples"))


@query()
def raw_filtered(spark, sf_dir):
    """The same read through the high pass and the common reference: mean, energy and extremes by channel."""
    g = _raw(spark, _recorded(spark, sf_dir)).groupBy(F.col("channel").cast("long").alias("channel"))
    return g.agg(F.round(F.avg("v"), 3).alias("mean"), F.round(F.sum(F.col("v").cast("double") * F.col("v")), -2).alias("energy"), F.round(F.max("v"), 2).alias("most"), F.round(F.min("v"), 2).alias("least"))


@query(f"""WITH {REC}, a AS (SELECT channel, count(*) AS n, round(sum(amp), 4) AS amp FROM train GROUP BY channel), b AS (SELECT channel, round(max(t), 4) AS t, count(*) AS late FROM train WHERE t >= 1000 AND channel % 2 = 0 GROUP BY channel)
    SELECT CAST(channel AS BIGINT) AS channel, a.n, CASE WHEN b.channel IS NULL THEN amp ELSE -amp END AS amp, b.late, b.t FROM a LEFT JOIN b USING (channel)""")
def metrics_snapshots(spark, sf_dir):
    """Metrics by channel in a versioned table: a first change, a later one with other fields and newer values, and its rerun."""
    table = Table(spark, f"{shared_dir(spark)}/tidemark-metrics-{uuid.uuid4().hex}", ["channel"], "version")
    s = R.train(spark, sf_dir).withColumn("channel", F.col("channel").cast("long"))
    first = s.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amp"), 4).alias("amp"))
    table.upsert(first.withColumn("version", F.lit(1)), "scan", 0)
    late = s.where("t >= 1000 and channel % 2 = 0").groupBy("channel").agg(F.round(F.max("t"), 4).alias("t"), F.count(F.lit(1)).alias("late"))
    late = late.join(first, "channel").select("channel", "t", "late", (-F.col("amp")).alias("amp"), F.lit(2).alias("version"))
    for _ in range(2):
        table.upsert(late, "scan", 1)
    return table.read().select("channel", "n", "amp", "late", "t")


@query("""SELECT a.event_id AS l_id, b.event_id AS r_id, epoch_us(b.ts) - epoch_us(a.ts) AS apart FROM events a JOIN events b
    ON a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 300000000""")
def stream_interval_pairs(spark, sf_dir):
    """Clicks and purchases at most five minutes apart, joined as two streams."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    at = f"{shared_dir(spark)}/tidemark-pairs-{uuid.uuid4().hex}"

    def side(kind):
        e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
        return e.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))

    pairs = interval_pairs(side("click"), side("purchase"), "5 minutes", "1 minute", bucket=300)
    q = pairs.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(pairs.schema).parquet(f"{at}/out")
    return out.select("l_id", "r_id", (F.unix_micros("r_ts") - F.unix_micros("l_ts")).alias("apart"))
