"""Fitted state as Parquet tables: sources, motion and pairs are checked, written beside a summary, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What must hold of each row of a table.
CHECKS: dict[str, dict[str, str]] = {
    "sources": {"active place": "n >= 0", "rank from 0": "rank >= 0", "amplitude": "amp >= 0 and not isnan(amp)", "captured": "captured >= -1e-6 * energy and captured <= energy * (1 + 1e-6) + 1e-9"},
    "motion": {"time": "t is not null and not isnan(t)", "window": "win >= 0", "displacement": "p is not null and not isnan(p)"},
    "pairs": {"bins": "t is not null and u is not null", "displacement": "not isnan(d)", "correlation": "c between -1.000001 and 1.000001"},
}
#: What identifies a row.
KEYS = {"sources": ["spike_id", "rank"], "motion": ["win", "t"], "pairs": ["t", "u"]}


def broken(df: DataFrame, kind: str) -> DataFrame:
    """check, rows: how many rows break each check, and how many keys are there more than once; one job, only counts."""
    bad = [F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in CHECKS[kind].items()]
    counts = df.agg(*bad)
    cells = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("rows")) for name in CHECKS[kind]])
    twice = df.groupBy(*KEYS[kind]).count().agg(F.count_if(F.col("count") > 1).alias("rows")).select(F.lit("repeated key").alias("check"), "rows")
    return counts.select(F.inline(cells)).union(twice)


def save(df: DataFrame, kind: str, path: str) -> None:
    """Writes the table if every check holds; raises ValueError with the counts if not.

    Rows are made once: they are written beside the path, checked there, and renamed to it only then.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    place, staged = hadoop(path), hadoop(f"{path}.staged-{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place):
        raise FileExistsError(path)
    try:
        df.write.parquet(staged.toString())
        found = {r["check"]: r["rows"] for r in broken(spark.read.schema(df.schema).parquet(staged.toString()), kind).where("rows > 0").collect()}
        if found:
            raise ValueError(f"{kind}: {found}")
        if not fs.rename(staged, place):
            raise FileExistsError(path)
    finally:
        fs.delete(staged, True)


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The table as saved; a missing column is an error that names it."""
    df = spark.read.parquet(path)
    lacking = [k for k in KEYS[kind] if k not in df.columns]
    if lacking:
        raise ValueError(f"{kind} at {path} lacks {lacking}")
    return df


def canonical(slots: Column, weight: str) -> Column:
    """Sources of a spike by falling weight, equal ones in their order, those without weight last."""
    numbered = F.transform(slots, lambda s, i: F.struct((-s[weight]).alias("_w"), i.alias("_i"), s.alias("_s")))
    return F.transform(F.array_sort(numbered), lambda x: x["_s"])
