"""Folding edit feeds into current tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key

# Which mask column of a patch feed governs which fields.
LOG_PATCH_FIELDS = {
    "completed": "sets_completed",
    "actual_start_min": "sets_times",
    "actual_end_min": "sets_times",
    "note": "sets_note",
}
LOG_KEY = ["owner_id", "activity_id", "log_date"]
REFLECTION_KEY = ["owner_id", "period_type", "period_date"]
SHARE_KEY = ["owner_id", "viewer_id"]


def upsert(current: DataFrame, edits: DataFrame, keys: list[str], order: list[str],
           removed: str | None = None) -> DataFrame:
    """Whole-row upsert; the edit with the greatest ``order`` wins.

    Rows of ``current`` that no edit touches pass through unchanged: with a
    small feed both joins become broadcasts by measured size and the table is
    not shuffled. ``current`` competes with its own ``order`` columns, or loses
    to every edit where it has none. ``removed`` names a tombstone flag.
    """
    newest = latest_per_key(edits, keys, order)
    touched_keys = newest.select(*keys)
    untouched = current.join(touched_keys, keys, "left_anti")
    touched = current.join(touched_keys, keys, "left_semi")
    kept = touched.unionByName(newest, allowMissingColumns=True)
    merged = latest_per_key(kept, keys, order)
    if removed:
        merged = merged.where(~F.coalesce(F.col(removed), F.lit(False)))
    return untouched.select(*current.columns).unionByName(merged.select(*current.columns))


def fold_patches(patches: DataFrame, keys: list[str], fields: dict[str, str],
                 order: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Field-by-field last write wins, in one aggregation.

    A patch speaks only for the fields its masks name, and a null it sets is
    a value. Per field the newest speaking patch wins, in any arrival order.
    """
    rank = F.struct(*order)
    folded = patches.groupBy(*keys).agg(*[
        F.max_by(F.col(field), F.when(F.col(mask), rank)).alias(field)
        for field, mask in fields.items()])
    for field, value in (defaults or {}).items():
        folded = folded.withColumn(field, F.coalesce(F.col(field), value))
    return folded


def fold_log_patches(patches: DataFrame) -> DataFrame:
    return fold_patches(patches, LOG_KEY, LOG_PATCH_FIELDS, ["ts", "seq"],
                        {"completed": F.lit(False)})


def patch_current_logs(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches merged over existing rows; rows without a patch pass through.

    An existing row is the oldest word on all of its fields.
    """
    keys = patches.select(*LOG_KEY).distinct()
    base = current.join(keys, LOG_KEY, "left_semi").select(
        *LOG_KEY, *LOG_PATCH_FIELDS,
        *[F.lit(True).alias(m) for m in dict.fromkeys(LOG_PATCH_FIELDS.values())],
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("seq"))
    merged = fold_log_patches(base.unionByName(patches.select(base.columns)))
    untouched = current.join(keys, LOG_KEY, "left_anti")
    columns = LOG_KEY + list(LOG_PATCH_FIELDS)
    return untouched.select(*columns).unionByName(merged.select(*columns))


def note_changes(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Notes that a feed really changes; an empty and a missing note are the same."""
    newest = fold_patches(patches.where("sets_note"), LOG_KEY, {"note": "sets_note"},
                          ["ts", "seq"])
    old = current.select(*LOG_KEY, F.col("note").alias("old_note"))
    blank = F.lit("")
    return newest.join(old, LOG_KEY, "left").where(
        F.coalesce("note", blank) != F.coalesce("old_note", blank))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str],
                 fields: list[str]) -> DataFrame:
    """Rows whose fields differ, with the old and the new values."""
    differs = reduce(lambda a, b: a | b, [
        ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")) for f in fields])
    same_key = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    return (old.alias("o").join(new.alias("n"), same_key).where(differs)
            .select(*[F.col(f"n.{k}").alias(k) for k in keys],
                    *[c for f in fields for c in (F.col(f"o.{f}").alias(f"old_{f}"),
                                                  F.col(f"n.{f}").alias(f))]))


def apply_changes(current: DataFrame, changes: DataFrame, keys: list[str],
                  fields: list[str]) -> DataFrame:
    """Write a change table (see ``changed_rows``) back into the table."""
    fresh = changes.select(*keys, F.struct(*fields).alias("_new"))
    joined = current.join(fresh, keys, "left")
    return joined.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        if c in fields else F.col(c) for c in current.columns])
