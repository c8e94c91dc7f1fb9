"""Data-quality jobs: the rules of ``model.TABLES`` as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TABLES


def _broken_rules(table: str) -> Column:
    rules = TABLES[table]
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in rules.required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.lit(f"{c} not allowed"))
               for c, allowed in rules.enums.items()]
    return F.array_compact(F.array(*checks))


def with_violations(df: DataFrame, table: str) -> DataFrame:
    """Each row with the list of check rules it breaks."""
    return df.withColumn("violations", _broken_rules(table))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a null in the key never clash."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (df.where(complete).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def all_duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Every clash on every key of the given tables, as (table, key, value, n)."""
    found = []
    for name, df in tables.items():
        for key in (TABLES[name].key, *TABLES[name].unique):
            value = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
            found.append(duplicate_keys(df, list(key)).select(
                F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"),
                value.alias("key_value"), "n"))
    return reduce(DataFrame.unionByName, found)


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that point to nothing, as (table, reference, row key, missing value)."""
    found = []
    for name, df in tables.items():
        rules = TABLES[name]
        row_key = F.concat_ws("|", *[F.col(k).cast("string") for k in rules.key])
        for columns, target, target_columns in rules.references:
            if target not in tables:
                continue
            there = tables[target].select(*[
                F.col(t).alias(c) for c, t in zip(columns, target_columns)])
            pointing = df.where(reduce(lambda a, b: a & b,
                                       [F.col(c).isNotNull() for c in columns]))
            found.append(pointing.join(there, list(columns), "left_anti").select(
                F.lit(name).alias("table_name"),
                F.lit(f"{','.join(columns)} -> {target}").alias("reference"),
                row_key.alias("row_key"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
                .alias("missing_value")))
    return reduce(DataFrame.unionByName, found)
