"""Reflections: private parts hidden, attached to days and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.private import hide_private


def redacted(df: DataFrame, column: str, mode: str = "blocks") -> DataFrame:
    return df.withColumn(column, hide_private(F.col(column), mode))


def with_reflection(df: DataFrame, reflections: DataFrame, period_type: str, at: Column,
                    name: str) -> DataFrame:
    """Add the owner's reflection on the period that starts at ``at``.

    The key of ``reflections`` makes this at most one row per input row.
    """
    texts = reflections.where(F.col("period_type") == period_type).select(
        F.col("owner_id").alias("_owner"), F.col("period_date").alias("_at"),
        F.col("content").alias(name))
    return df.join(texts, (F.col("owner_id") == F.col("_owner")) & (at == F.col("_at")),
                   "left").drop("_owner", "_at")
