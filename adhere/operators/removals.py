"""Deletes and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TABLES, TableRules
from ..session import store

# Tables an owner's rows live in, and the columns that name the owner there.
OWNER_COLUMNS = {
    "profiles": ("owner_id",), "activities": ("owner_id",), "logs": ("owner_id",),
    "reflections": ("owner_id",), "shares": ("owner_id", "viewer_id"),
    "goals": ("owner_id",),
}


def delete_activities(activities: DataFrame, logs: DataFrame,
                      gone: DataFrame) -> dict[str, DataFrame]:
    """Remaining activities and logs, and the removed logs for the record."""
    keys = gone.select("activity_id")
    return {
        "activities": activities.join(keys, "activity_id", "left_anti"),
        "logs": logs.join(keys, "activity_id", "left_anti"),
        "removed_logs": logs.join(keys, "activity_id", "left_semi"),
    }


def delete_goals(goals: DataFrame, activities: DataFrame,
                 gone: DataFrame) -> dict[str, DataFrame]:
    """Remaining goals; their activities stay and lose the tag.

    The deleted keys are made distinct so the join cannot multiply rows.
    """
    keys = gone.select("goal_id").distinct()
    flagged = activities.join(keys.withColumn("_gone", F.lit(True)), "goal_id", "left")
    cleared = flagged.withColumn("goal_id", F.when(F.col("_gone").isNull(), F.col("goal_id")))
    return {
        "goals": goals.join(keys, "goal_id", "left_anti"),
        "activities": cleared.select(*activities.columns),
    }


def erase_owners(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given owners, at either end."""
    out = {}
    for name, df in tables.items():
        for column in OWNER_COLUMNS[name]:
            df = df.join(gone.select(F.col("owner_id").alias(column)), column, "left_anti") \
                .select(*df.columns)
        out[name] = df
    return out


def dependency_order(names: Iterable[str], rules: Mapping[str, TableRules] = TABLES) -> list[str]:
    """The tables, each after all tables it refers to; a ring of references has no such order."""
    left, out = list(names), []
    while left:
        free = [n for n in left if all(t == n or t not in left for _, t, _ in rules[n].references)]
        if not free:
            raise ValueError(f"references in a ring: {', '.join(left)}")
        out += free
        left = [n for n in left if n not in free]
    return out


def remove(tables: Mapping[str, DataFrame], gone: Mapping[str, DataFrame],
           rules: Mapping[str, TableRules] = TABLES) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows whose keys are ``gone``, and without what referred to them.

    ``gone`` holds keys (the columns of the table's key) of any of the tables, all removed at once. Tables are
    taken in the order of their references: a row that refers to a removed one goes as well, or loses
    the reference where the model says so. Only removed keys are stored, each table is joined with those of the
    tables it refers to, and Spark sends them or shuffles by their size.

    Also returns the record: table_name, row_key, fate ("removed" or "unlinked") and cause ("given", or the
    first reference that led to it). Keys that are not there, or are given twice, change nothing; a
    reference that is null refers to nothing. References to tables not given are not followed.
    """
    unknown = set(gone) - set(tables)
    if unknown:
        raise ValueError(f"keys of tables not given: {', '.join(sorted(unknown))}")
    kept: dict[str, DataFrame] = {}
    removed: dict[str, DataFrame] = {}
    records = []
    for name in dependency_order(tables, rules):
        own, df = rules[name], tables[name]
        columns = df.columns
        marked = df.withColumn("_cause", F.lit(None).cast("string"))
        if name in gone:
            marked = _marked(marked, own.key, gone[name], own.key, "_given").withColumn(
                "_cause", F.when(F.col("_given"), "given")).drop("_given")
        nulls = []
        for here, target, there in own.references:
            if target not in removed:
                continue
            flag = "_" + "_".join(here)
            marked = _marked(marked, here, removed[target], there, flag)
            if here in own.set_null:
                nulls.append((flag, here))
            else:
                marked = marked.withColumn("_cause", F.coalesce("_cause", F.when(
                    F.col(flag), f"{','.join(here)} -> {target}"))).drop(flag)
        wanted = {c for rule in rules.values() for _, target, there in rule.references if target == name
                  for c in there}
        row_key = F.concat_ws("|", *[F.col(k).cast("string") for k in own.key])
        lost = store(marked.where(F.col("_cause").isNotNull()).select(
            *sorted(wanted | set(own.key)), "_cause"), f"removed-{name}")
        removed[name] = lost
        records.append(_record(lost, name, row_key, "removed", F.col("_cause")))
        left = marked.where(F.col("_cause").isNull())
        for flag, here in nulls:
            records.append(_record(left.where(flag), name, row_key, "unlinked", F.lit(",".join(here))))
            left = left.withColumns({c: F.when(~F.col(flag), F.col(c)) for c in here})
        kept[name] = left.select(*columns)
    return {name: kept[name] for name in tables}, reduce(DataFrame.unionByName, records)


def _marked(df: DataFrame, here: tuple[str, ...], keys: DataFrame, there: tuple[str, ...], flag: str) -> DataFrame:
    """``flag`` says whether the columns ``here`` are among the keys."""
    found = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(there)], F.lit(True).alias(flag)).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(here)])
    return df.join(found, same, "left").drop(*[f"_k{i}" for i in range(len(here))]).withColumn(
        flag, F.coalesce(flag, F.lit(False)))


def _record(rows: DataFrame, name: str, row_key: Column, fate: str, cause: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("table_name"), row_key.alias("row_key"), F.lit(fate).alias("fate"),
                       cause.alias("cause"))
