"""Joining rows to a table of unique keys when a few keys may hold a large share of the rows.

Keys are counted first (partial sums come before the shuffle). A key is frequent if it
holds at least one in ``SHARE`` of all rows, so there can be no more than ``SHARE`` of
them, whatever the data: their entries are sent to every task. All other rows
meet their entries in a shuffled join, in which the rows of frequent and of null keys, which have
nothing to find there, are spread by what else they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store

#: A key of at least one in so many rows is frequent; also the most keys that can be.
SHARE = 1000


def frequent_keys(rows: DataFrame, key: str, share: int = SHARE,
                  counts: DataFrame | None = None) -> DataFrame:
    """(frequent) the keys that hold at least one in ``share`` of all rows: at most ``share`` rows.

    ``counts`` (key, n) may bring counts made before; otherwise they are stored. One number, the rows
    in all, comes to the driver.
    """
    if counts is None:
        counts = store(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col(key).isNotNull() & (F.col("n") * share >= total)).select(
        F.col(key).alias("frequent"))


def lookup(rows: DataFrame, entries: DataFrame, key: str, entry_key: str, how: str = "inner",
           share: int = SHARE, counts: DataFrame | None = None,
           spread_by: list[str] | None = None) -> DataFrame:
    """All columns of ``rows`` and those of their entry but ``entry_key``.

    ``entries`` has each key at most once; its columns are named unlike those of ``rows``. ``how`` is
    "inner" or "left"; a null key finds nothing. ``spread_by`` names the columns whose values
    spread rows that have nothing to find in the shuffle, all by default.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"lookup joins are inner or left, not {how}")
    found = [c for c in entries.columns if c != entry_key]
    frequent = frequent_keys(rows, key, share, counts)
    hot = entries.join(F.broadcast(frequent), F.col(entry_key) == F.col("frequent"), "left_semi").select(
        F.col(entry_key).alias("_hot_key"), *(F.col(c).alias(f"_hot_{c}") for c in found))
    # Frequent keys without an entry are known as well.
    hot = frequent.join(F.broadcast(hot), F.col("frequent") == F.col("_hot_key"), "left")
    own = rows.join(F.broadcast(hot), F.col(key) == F.col("frequent"), "left")
    apart = F.col("frequent").isNotNull() | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(*(spread_by or rows.columns)), F.lit(2 ** 31)) + 1
    own = own.withColumn("_place", F.when(apart, spread).otherwise(0))
    # Always 0, but no literal: a literal would leave the place out of the shuffle.
    cold = entries.where(F.col(entry_key).isNotNull()).withColumn(
        "_zero", F.pmod(F.xxhash64(entry_key), F.lit(1)))
    joined = own.join(cold, (F.col(key) == F.col(entry_key)) & (F.col("_place") == F.col("_zero")), "left")
    hot_hit = F.col("_hot_key").isNotNull()
    if how == "inner":
        joined = joined.where(hot_hit | F.col(entry_key).isNotNull())
    return joined.select(*rows.columns, *(
        F.when(hot_hit, F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in found))
