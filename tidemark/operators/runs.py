"""The index over saved fits: one row a run from its summary, its history, and metrics kept elsewhere; filters and sorts that users pick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "config map<string,string>, K long, KS long, Q long, learned boolean, fingerprint string, spikes long, cands_used long, sites_used long, sse double"
#: Names that a step, an error and a time go by in histories of different ages.
ALIASES = {"step": ("step", "iteration", "k"), "nmse": ("nmse", "objective", "loss"), "seconds": ("wall_s", "wall_seconds", "seconds")}


def _run(column: str = "_file"):
    return F.regexp_extract(F.col(column), r"([^/]+)/[^/]+$", 1).alias("run")


def summaries(spark: SparkSession, root: str) -> DataFrame:
    """run (its folder's name) and the summary's fields; folders without a summary, being incomplete, aren't there."""
    t = spark.read.text(f"{root}/*/summary.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    return t.select(_run(), F.from_json("value", SUMMARY).alias("s")).select("run", "s.*")


def histories(spark: SparkSession, root: str) -> DataFrame:
    """run, step, nmse, seconds of all runs' histories (a JSON object a line); fields under any of their names, broken lines left out."""
    every = sorted({n for names in ALIASES.values() for n in names})
    t = spark.read.text(f"{root}/*/history.jsonl").select("value", F.col("_metadata.file_path").alias("_file"))
    h = t.select(_run(), F.from_json("value", ", ".join(f"{n} double" for n in every)).alias("h")).where("h is not null")
    h = h.select("run", *[F.coalesce(*[F.col(f"h.{n}") for n in names]).alias(out) for out, names in ALIASES.items()])
    return h.where(F.col("step").isNotNull()).withColumn("step", F.col("step").cast("long"))


def converged(history: DataFrame) -> DataFrame:
    """run, steps, first and last error, the least and the step at which it came, and whether the error ever rose."""
    from pyspark.sql import Window

    before = F.lag("nmse").over(Window.partitionBy("run").orderBy("step"))
    h = history.withColumn("rose", F.coalesce(F.col("nmse") > before + 1e-12, F.lit(False)))
    g = h.groupBy("run").agg(F.count(F.lit(1)).alias("steps"), F.min_by("nmse", "step").alias("first"), F.max_by("nmse", "step").alias("last"), F.min(F.struct("nmse", "step")).alias("best"), F.max("rose").alias("rose"))
    return g.select("run", "steps", "first", "last", F.col("best.nmse").alias("least"), F.col("best.step").alias("at"), "rose")


def index(spark: SparkSession, root: str, metrics: DataFrame | None = None) -> DataFrame:
    """One row a run: summary, convergence, and its metrics where there are any (columns of `metrics`, keyed by run)."""
    out = summaries(spark, root).join(converged(histories(spark, root)), "run", "left")
    return out if metrics is None else out.join(metrics, "run", "left")


def filtered(runs: DataFrame, equal: dict[str, object] | None = None, present: list[str] = ()) -> DataFrame:
    """Rows that equal the given values (None: null) and in which the named columns aren't null; an unknown column is an error."""
    lacking = [c for c in [*(equal or {}), *present] if c not in runs.columns]
    if lacking:
        raise ValueError(f"no such columns: {lacking}")
    for c, v in (equal or {}).items():
        runs = runs.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    for c in present:
        runs = runs.where(F.col(c).isNotNull())
    return runs


def ordered(runs: DataFrame, by: str, falling: bool = False) -> DataFrame:
    """Sorted by a column, nulls last in both directions, ties by run."""
    return runs.orderBy(F.col(by).desc_nulls_last() if falling else F.col(by).asc_nulls_last(), "run")
