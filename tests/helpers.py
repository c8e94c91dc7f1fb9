"""Small tables for hand-written cases."""

import datetime as dt

from pyspark.sql import functions as F

from adhere import model

D = dt.date


def table(spark, name, rows):
    """Rows given as dicts; columns left out are null."""
    schema = model.TABLES[name].schema
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


def values(df, *columns):
    """Rows in order, nulls first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()),
                  key=lambda row: [(v is not None, v) for v in row])


def one_row(spark):
    return spark.range(1)


def evaluate(spark, **columns):
    row = one_row(spark).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]
    return row.asDict()


def routine(spark, owner=1):
    """The default routine as one owner's activities."""
    from adhere.sources.readers import default_routine
    return default_routine(spark).select(
        F.concat_ws(":", F.lit(owner), "day_type", "sort_order").alias("activity_id"),
        F.lit(owner).cast("long").alias("owner_id"), "title", "day_type", "planned_start_min",
        "planned_end_min", "category", "sort_order", F.lit(None).cast("date").alias("entry_date"),
        F.lit(None).cast("string").alias("color"), F.lit(None).cast("long").alias("goal_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
