"""Writing. Writers make a whole new folder, and readers switch to it; only ``upsert_months`` changes a
table in place, and of it the months its feed touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upserts import LOG_KEY, upsert
from ..session import store


def write_rows(df: DataFrame, path: str) -> None:
    """Flat result rows as parquet, in files AQE sizes evenly."""
    df.hint("rebalance").write.mode("errorifexists").parquet(path)


def write_logs(logs: DataFrame, path: str) -> None:
    """The logs table, one folder per month.

    The rebalance keeps a month together where it is small and splits it over
    many tasks where it is large, so neither tiny files nor one giant task
    result. Rows are ordered by owner in each file for min/max skipping.
    """
    (logs.withColumn("log_month", F.date_format("log_date", "yyyy-MM"))
         .hint("rebalance", "log_month")
         .sortWithinPartitions("log_month", "owner_id", "log_date")
         .write.mode("errorifexists").partitionBy("log_month").parquet(path))


def _by_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("log_month", F.date_format("log_date", "yyyy-MM")).hint(
        "rebalance", "log_month").sortWithinPartitions("log_month", "owner_id", "log_date")


def write_months(rows: DataFrame, path: str) -> None:
    """A table of logs with whatever order columns it has, one folder per month."""
    _by_month(rows).write.mode("errorifexists").partitionBy("log_month").parquet(path)


def read_months(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("log_month", T.StringType())])).parquet(
        path).drop("log_month")


def upsert_months(feed: DataFrame, path: str, order: list[str], removed: str | None = None) -> list[str]:
    """Upserts a feed of whole rows into a table of ``write_months``; returns the months it touched.

    Only those months are read and written: their folders are replaced, all other files stay as they are. The
    merged rows go to the shared folder first, as a table cannot be replaced while it is read; if the job fails
    between, running it again with the same feed gives the same table. One job at a time may write a table.
    The months' names come to the driver. ``removed`` names a tombstone flag of the feed. A month whose last
    row is removed keeps one empty file. A feed without rows changes nothing.
    """
    spark = feed.sparkSession
    dated = feed.where(F.col("log_date").isNotNull()).withColumn("log_month", F.date_format("log_date", "yyyy-MM"))
    months = sorted(r.log_month for r in dated.select("log_month").distinct().collect())
    if not months:
        return []
    columns = [c for c in feed.columns if c != removed]
    fields = [f for f in feed.schema.fields if f.name != removed]
    current = spark.read.schema(T.StructType([*fields, T.StructField("log_month", T.StringType())])).parquet(
        path).where(F.col("log_month").isin(months)).select(*columns)
    merged = store(upsert(current, feed.where(F.col("log_date").isNotNull()), LOG_KEY, order, removed), "merged-months")
    # Replaces the folders of the months there are rows of; a month that lost all of its rows is emptied after it.
    _by_month(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "log_month").parquet(path)
    left = {r.m for r in merged.select(F.date_format("log_date", "yyyy-MM").alias("m")).distinct().collect()}
    for month in set(months) - left:
        merged.limit(0).write.mode("overwrite").parquet(f"{path}/log_month={month}")
    return months


def write_by_code(rows: DataFrame, path: str, code: str = "share_code", group_bytes: int = 8 << 20,
                  codes_per_group: int = 10_000) -> None:
    """Rows in the order of a code, for readers that ask for one (``readers.read_code``).

    A range sort gives each file and row group a narrow span of codes, so their minima and maxima rule out all
    groups but one or two; a Bloom filter per group rules out codes that nobody has. A code with very many
    rows covers several groups, all of them its own.
    """
    (rows.repartitionByRange(code).sortWithinPartitions(code).write.mode("errorifexists")
     .option("parquet.block.size", group_bytes)
     .option(f"parquet.bloom.filter.enabled#{code}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{code}", codes_per_group)
     .parquet(path))


def write_documents(df: DataFrame, path: str) -> None:
    """Nested documents as JSON lines; null fields are kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def as_json(column: str) -> Column:
    """A nested value as JSON text; null fields are kept."""
    return F.to_json(column, {"ignoreNullFields": "false"})
