"""Row positions inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import store

_PART_BITS = 33


def with_positions(df: DataFrame, keys: list[str], order: list[Column],
                   name: str = "position", size: str | None = None) -> DataFrame:
    """Exact positions, from 0, by ``order`` inside each ``keys`` group; nulls come first.

    One plan for every size: all rows are sorted by group and order over range
    partitions, so a group that is large simply covers several of them. A row's
    place in the whole less the place of its group's first row is its position.
    Rows that tie in ``order`` get different positions in any order, so ``order``
    should end in a key.

    The sorted rows go to the shared folder when this is called, since range
    bounds are sampled and must not change between uses; of them only the row
    count per partition comes to the driver. ``size`` names a column for the size
    of the group, if wanted.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [f"_order{i}" for i in range(len(order))]
    sort = [*keys, *by]
    placed = store(
        df.withColumns(dict(zip(by, order))).repartitionByRange(parts, *sort)
        .sortWithinPartitions(*sort).drop(*by)
        .withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", _PART_BITS)
    counts = dict(placed.groupBy(part.alias("_part")).count().collect())
    starts, before = [], 0
    for p in range(parts):
        starts.append(before)
        before += counts.get(p, 0)
    place = F.element_at(F.lit(starts), (part + 1).cast("int")) \
        + F.col("_at").bitwiseAND((1 << _PART_BITS) - 1)
    rows = placed.withColumns({"_place": place.cast("long"), "_part": part}).drop("_at")
    # A row per group and partition, however large the group; of one group there is at most one in each.
    runs = rows.groupBy("_part", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(
        F.min("_place").alias("_begin"), F.count(F.lit(1)).alias("_rows"))
    group = W.partitionBy(*[f"_key{i}" for i in range(len(keys))])
    runs = runs.select(F.col("_part").alias("_run_part"), *[f"_key{i}" for i in range(len(keys))],
                       F.min("_begin").over(group).alias("_first"), F.sum("_rows").over(group).alias("_size"))
    # Rows meet their run, not their group: a large group stays spread over its partitions.
    same = reduce(lambda a, b: a & b, [
        F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return rows.join(runs, same & (F.col("_part") == F.col("_run_part"))).select(
        *df.columns, (F.col("_place") - F.col("_first")).alias(name),
        *([F.col("_size").alias(size)] if size else []))
