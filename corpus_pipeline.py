"""Corpus pipeline: toxicity, n-gram Jaccard join, secret scans, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and
reads it again for the next. All but the last stage return the columns of documents. No stage drops a document but for its own
decision: toxic, or linked to one of smaller doc_id. Documents without a doc_id pass the join. There is no SQL for the whole:
toxicity scores and token ids have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, mixing, secrets, toxicity
from tidemark.llm.shared import handed_back, rested, tune, written


def begun(spark: SparkSession) -> None:
    """Settings of a stage, and what the stages before it left on the driver and the executors: Spark's cleaner frees the broadcasts and
    shuffles of ended queries only once the JVM has collected their handles, and heaps shrink only then."""
    tune(spark)
    handed_back(True)
    spark.sparkContext._jvm.java.lang.System.gc()
    rested(spark)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; labels of held-out rows aren't learnt from."""
    begun(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, f"not ({toxicity.HELD_OUT})")
    return toxicity.scored(docs, model, "toxicity_score").where("toxicity_score < 0.5").drop("toxicity_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id."""
    begun(spark)
    found = jaccard.classes(docs.select("doc_id", "text"))
    gone = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    begun(spark)
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    begun(spark)
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each text's ids and of what they decode to."""
    begun(spark)
    return bpe.digest(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
