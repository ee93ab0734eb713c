"""A recording as DataFrames: spikes, channels, neighbours, waypoints - here derived from the events and embeddings tables.

Every event is a spike: 30 days map to 1958 s at 30 kHz by integer arithmetic, the channel is one of 64, and the waveform is one
of the embedding vectors, scaled by the event's value and read as 8 neighbouring channels x 8 samples, row-major.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FS = 30_000
CHANNELS, SLOTS, SAMPLES = 64, 8, 8
#: Ground-truth motion: knots of a zigzag between 0 and 50 um.
WAYPOINTS = ((0.0, 0.0), (400.0, 50.0), (800.0, 0.0), (1200.0, 50.0), (1600.0, 0.0), (1958.0, 44.75))


#: Spikes a task: what follows works for up to a millisecond on each.
TASK = 50_000


def _dealt(events: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the cluster before their waveforms join them: the scan of a small or coarse file is one task or a few, and a narrow
    stage keeps that number whatever it costs a row."""
    tasks = max(2 * events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // TASK))
    return events.repartition(tasks, key)


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spike_id, sample, t (s), channel, user_id, kind, amp, w (array<double> of SLOTS * SAMPLES)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = vectors.count()
    e = _dealt(events.select("event_id", "ts", "user_id", "event_type", "value"), "event_id").select(
        F.col("event_id").alias("spike_id"),
        F.expr("(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) * 979) div 43200000").alias("sample"),
        ((F.col("user_id") * 7 + F.col("event_id")) % CHANNELS).cast("int").alias("channel"),
        "user_id",
        F.col("event_type").alias("kind"),
        F.col("value").alias("amp"),
        (F.col("event_id") % n).alias("vec_id"),
    )
    w = F.transform("embedding", lambda x: x.cast("double") * (F.col("amp") / 10))
    return e.join(vectors, "vec_id").select("spike_id", "sample", (F.col("sample") / FS).alias("t"), "channel", "user_id", "kind", "amp", w.alias("w"))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spikes without waveforms: the scan reads no embeddings."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sample = F.expr("(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) * 979) div 43200000")
    channel = ((F.col("user_id") * 7 + F.col("event_id")) % CHANNELS).cast("int")
    return e.select(F.col("event_id").alias("spike_id"), sample.alias("sample"), (sample / FS).alias("t"), channel.alias("channel"), "user_id", F.col("event_type").alias("kind"), F.col("value").alias("amp"))


def channels(spark: SparkSession) -> DataFrame:
    """channel, x, y (um): four staggered columns; always 64 rows."""
    c = spark.range(CHANNELS)
    row = F.expr("id div 4")
    return c.select(F.col("id").cast("int").alias("channel"), ((F.col("id") % 4) * 20 + (row % 2) * 10).cast("double").alias("x"), (row * 20).cast("double").alias("y"))


def neighbors(spark: SparkSession, k: int = SLOTS) -> DataFrame:
    """channel, slot, nbr, dx, dy: the k nearest contacts, ties to the smaller id."""
    from pyspark.sql import Window

    a, b = channels(spark).alias("a"), channels(spark).alias("b")
    d2 = F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2)
    pairs = a.join(F.broadcast(b), F.abs(F.col("a.y") - F.col("b.y")) <= 200).select(F.col("a.channel").alias("channel"), F.col("b.channel").alias("nbr"), (F.col("b.x") - F.col("a.x")).alias("dx"), (F.col("b.y") - F.col("a.y")).alias("dy"), d2.alias("d2"))
    slot = F.row_number().over(Window.partitionBy("channel").orderBy("d2", "nbr")) - 1
    return pairs.select("channel", slot.alias("slot"), "nbr", "dx", "dy").where(F.col("slot") < k)


def geometry(spark: SparkSession, k: int = SLOTS) -> DataFrame:
    """channel, x, y, dx, dy (arrays by slot), cfg (equal for channels with equal neighbour offsets); 64 rows."""
    from pyspark.sql import Window

    n = neighbors(spark, k).groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("slot", "dx", "dy"))).alias("s"))
    n = n.select("channel", F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"))
    cfg = (F.dense_rank().over(Window.orderBy("dx", "dy")) - 1).alias("cfg")
    return channels(spark).join(n.select("channel", "dx", "dy", cfg), "channel")


def waypoints(spark: SparkSession) -> DataFrame:
    """t, pos, t1, pos1: each segment of the ground-truth motion with its end."""
    return spark.createDataFrame([(*a, *b) for a, b in zip(WAYPOINTS, WAYPOINTS[1:])], "t0 double, p0 double, t1 double, p1 double")
