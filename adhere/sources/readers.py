"""Scans. Every table is read with its explicit schema, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions.clock import parse_hhmm
from ..functions.names import PAGE_BLANKS
from ..model import TABLES, Horizon
from ..operators.latest import latest_per_key


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring older rows to the current schema: missing columns become nulls.

    Columns the schema does not know are left out; nothing else changes, so a
    file written before a column was added still reads.
    """
    present = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[table].schema])


def read_table(spark: SparkSession, table: str, path: str, fmt: str = "parquet",
               **options) -> DataFrame:
    """One of the six tables from any Spark file source."""
    df = spark.read.schema(TABLES[table].schema).options(**options).format(fmt).load(path)
    return conform(df, table)


def read_logs(spark: SparkSession, path: str, horizon: Horizon | None = None,
              newest_only: bool = False) -> DataFrame:
    """Logs as ``sinks.write_logs`` lays them out.

    ``newest_only`` keeps the newest row of a key that was written more than once.

    A horizon filters the month folders first, so only those are listed and
    read, and then the days within them.
    """
    month = T.StructField("log_month", T.StringType())
    df = spark.read.schema(T.StructType([*TABLES["logs"].schema, month])).parquet(path)
    if horizon is not None:
        df = df.where(F.col("log_month").between(f"{horizon.start:%Y-%m}",
                                                 f"{horizon.end:%Y-%m}")
                      & F.col("log_date").between(horizon.start, horizon.end))
    df = conform(df, "logs")
    return latest_per_key(df, list(TABLES["logs"].key), ["updated_at"]).select(df.columns) \
        if newest_only else df


def read_code(spark: SparkSession, path: str, schema: T.StructType, typed: str,
              code: str = "share_code") -> DataFrame:
    """The rows of one code, as typed, from a table of ``sinks.write_by_code``; no rows if nobody has it.

    The cleaned code is a literal in the scan's filter, so only row groups that may hold it are read.
    """
    cleaned = typed.strip(PAGE_BLANKS).upper()
    return spark.read.schema(schema).parquet(path).where(F.col(code) == F.lit(cleaned))


def of_owner(df: DataFrame, owner_id) -> DataFrame:
    return df.where(F.col("owner_id") == owner_id)


def recurring(activities: DataFrame) -> DataFrame:
    return activities.where(F.col("entry_date").isNull())


def one_offs(activities: DataFrame, horizon: Horizon | None = None) -> DataFrame:
    if horizon is None:
        return activities.where(F.col("entry_date").isNotNull())
    return activities.where(F.col("entry_date").between(horizon.start, horizon.end))


def in_horizon(df: DataFrame, column: str, horizon: Horizon) -> DataFrame:
    return df.where(F.col(column).between(horizon.start, horizon.end))


def default_routine(spark: SparkSession) -> DataFrame:
    """The built-in template as a table (eleven rows, whatever the data size)."""
    raw = spark.createDataFrame(
        V.DEFAULT_ROUTINE, "title string, day_type string, planned_start string, "
                           "planned_end string, category string, sort_order int")
    return raw.select("title", "day_type",
                      parse_hhmm(F.col("planned_start")).alias("planned_start_min"),
                      parse_hhmm(F.col("planned_end")).alias("planned_end_min"),
                      "category", "sort_order")
