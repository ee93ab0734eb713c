"""Structured Streaming forms: tumbling bins with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """start, n, amp by tumbling window of ts (a timestamp)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("amp")).select(F.col("window.start").alias("start"), "n", "amp")


def drained(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a streaming aggregation over what is there and returns its table, which lies beside the checkpoint.

    Complete mode: windows that the watermark hasn't passed are written too, and late rows count.
    """
    spark = stream.sparkSession
    out = f"{checkpoint.rstrip('/')}-{name}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    # an empty table first, unless an earlier run left one
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(out)
    q = stream.writeStream.foreachBatch(put).queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
