"""Session helpers of the corpus operators: Arrow batch size, shared folder, lineage cuts, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only on one machine, where it is unset (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def tune(spark: SparkSession) -> None:
    """Small Arrow batches (texts can be long), and shuffle files that go when the query that wrote them ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def with_field(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of df and one more column."""
    more = df.sparkSession.createDataFrame([], f"x {kind}").schema[0].dataType
    return T.StructType([*df.schema.fields, T.StructField(name, more)])


_caches: list = []


def kept_in_worker(make: Callable) -> Callable:
    """make, whose last two results a Python worker keeps from task to task, until a task of another operator (see lean) begins there."""
    _caches.append(cached := lru_cache(maxsize=2)(make))
    return cached


def handed_back(caches: bool = False) -> None:
    """Gives this process' freed memory back to the system; with `caches`, what kept_in_worker holds as well."""
    for cached in _caches if caches else ():
        cached.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """An Arrow task that hands its freed memory back to the system when it ends, and first what other operators keep in its Python worker:
    workers live on, and would keep both from the stages after."""

    def task(batches):
        if holding():
            handed_back(True)
        yield from run(batches)
        handed_back()

    return task


def holding() -> bool:
    return any(c.cache_info().currsize for c in _caches)


def rested(spark: SparkSession) -> int:
    """Garbage of ended queries is collected in the executors, whose heaps else keep the largest size they ever had; how many tasks did it."""
    n = 2 * spark.sparkContext.defaultParallelism
    return len(spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect())


def parted(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> Iterator[DataFrame]:
    """df as a table in the shared folder, bucketed by a column: joins on it don't shuffle these rows again. Gone after the with block, so
    what is read from it must be written before."""
    spark = df.sparkSession
    table = f"tidemark_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"drop table if exists {table}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() made, once all that was read from them is written itself."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b: each node that isn't the smallest of its component, with that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


_EDGES = "a long, b long"


def _contract(batches):
    """Links of one task to a spanning forest, a few hundred thousand at a time."""
    keep_a, keep_b, held = [], [], 0

    def out():
        a, b = forest(np.concatenate(keep_a), np.concatenate(keep_b))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keep_a.append(batch.column(0).to_numpy(zero_copy_only=False))
        keep_b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= 400_000:
            yield out()
            keep_a, keep_b, held = [], [], 0
    if held:
        yield out()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b), non-null: node, component (its smallest node), for linked nodes.

    Alternating large-star and small-star steps (each a minimum per node, aggregated before the shuffle, and a join back
    that adaptive execution can split where a node is hot), after a contraction inside each task. Each round is written to
    the shared folder. Nothing is collected but two sums that tell whether a round changed anything.
    """
    e = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, _EDGES)
    e = written(e.distinct(), "links")
    before = None
    for _ in range(rounds):
        last = e
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = e.where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = written(e.where("a <> b").distinct(), "stars")
        dropped(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
