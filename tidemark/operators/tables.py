"""Keyed tables: latest-wins upserts with field-level fill, and the run index joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """base merged with changes by key: for each field the latest non-null value of either, by version."""
    both = base.unionByName(changes, allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (*keys, version)]
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in fields]
    return both.groupBy(*keys).agg(F.max(version).alias(version), *latest)
