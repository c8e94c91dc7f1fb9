"""Who shares what with whom."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_PERMISSION
from ..functions import names as N
from ..functions.rows import several_rows
from ..sources.readers import recurring
from .latest import latest_per_key
from .lookups import lookup


def of_codes(profiles: DataFrame, codes: DataFrame) -> DataFrame:
    """Profiles whose share code is in a list of codes as people type them."""
    wanted = codes.select(N.clean_code(F.col("code")).alias("share_code"))
    return profiles.join(wanted, "share_code", "left_semi")


def public_schedule(profiles: DataFrame, activities: DataFrame,
                    recurring_only: bool = True) -> DataFrame:
    """The template of every owner with a share code, under the owner's name.

    ``recurring_only=False`` lets one-off entries through as well.
    """
    plan = recurring(activities) if recurring_only else activities
    people = profiles.where(F.col("share_code").isNotNull()).select(
        "owner_id", "share_code",
        N.owner_name(F.col("display_name"), F.col("username")).alias("owner_name"))
    return plan.join(people, "owner_id").select(
        "share_code", "owner_name", "title", "day_type", "planned_start_min",
        "planned_end_min", "category", "sort_order")


def share_lists(profiles: DataFrame, shares: DataFrame) -> DataFrame:
    """Both lists of the sharing page for everybody, with one join.

    Each share is turned into an ``out`` row of its owner and an ``in`` row of
    its viewer; the name looked up is the other end's.
    """
    owner, viewer = F.col("owner_id"), F.col("viewer_id")
    ends = shares.select(several_rows(
        dict(person_id=owner, direction=F.lit("out"), other_id=viewer,
             permission=F.col("permission")),
        dict(person_id=viewer, direction=F.lit("in"), other_id=owner,
             permission=F.col("permission"))))
    people = profiles.select(
        F.col("owner_id").alias("other_id"), F.col("username").alias("other_username"),
        N.person_label(F.col("display_name"), F.col("username")).alias("other_name"))
    return ends.join(people, "other_id").select(
        "person_id", "direction", "other_id", "other_name", "other_username", "permission")


def resolve_requests(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Find the person behind each typed code and say what becomes of it.

    A request that names no permission asks for the least one.
    """
    people = profiles.where(F.col("share_code").isNotNull()).select(
        F.col("share_code").alias("known_code"), F.col("owner_id").alias("viewer_id"), "username")
    typed = requests.withColumns({
        "share_code": N.clean_code(F.col("code")),
        "permission": F.coalesce("permission", F.lit(DEFAULT_PERMISSION))})
    # A code that many type, known or not, does not gather its requests in one task.
    found = lookup(typed, people, "share_code", "known_code", "left")
    return found.withColumn(
        "outcome",
        F.when(F.col("share_code") == "", "blank")
        .when(F.col("viewer_id").isNull(), "unknown code")
        .when(F.col("viewer_id") == F.col("owner_id"), "own code")
        .otherwise("granted"))


def granted_shares(resolved: DataFrame) -> DataFrame:
    """The share rows that result; a later request replaces an earlier one."""
    good = resolved.where(F.col("outcome") == "granted") \
        .select("owner_id", "viewer_id", "permission", "ts", "seq")
    return latest_per_key(good, ["owner_id", "viewer_id"], ["ts", "seq"]) \
        .select("owner_id", "viewer_id", "permission")


def grants(profiles: DataFrame, shares: DataFrame) -> DataFrame:
    """(viewer, owner, permission): oneself, and what others share."""
    own = profiles.select(F.col("owner_id").alias("viewer_id"), "owner_id",
                          F.lit("edit").alias("permission"))
    given = shares.where(F.col("owner_id") != F.col("viewer_id")) \
        .select("viewer_id", "owner_id", "permission")
    return own.unionByName(given)


def editable(granted: DataFrame) -> DataFrame:
    return granted.where(F.col("permission") == "edit")


def visible_to(table: DataFrame, granted: DataFrame, viewers: DataFrame) -> DataFrame:
    """Rows of a table that the given viewers may read, by viewer."""
    mine = granted.join(viewers.select("viewer_id"), "viewer_id", "left_semi") \
        .select("viewer_id", "owner_id")
    return table.join(mine, "owner_id")


def shares_visible_to(shares: DataFrame, viewers: DataFrame) -> DataFrame:
    """Shares are readable at both ends, whatever the permission."""
    ends = shares.withColumn("reader_id", F.explode(F.array_distinct(
        F.array("owner_id", "viewer_id"))))
    wanted = viewers.select(F.col("viewer_id").alias("reader_id"))
    return ends.join(wanted, "reader_id", "left_semi")


def visible_counts(tables: dict[str, DataFrame], shares: DataFrame,
                   granted: DataFrame) -> DataFrame:
    """For every viewer, how many rows of each table are readable.

    Rows are counted per owner before they meet the grants, so the (viewer,
    row) pairs are never formed.
    """
    def counts(df: DataFrame, which: str) -> DataFrame:
        return df.select("owner_id", *[
            F.lit(1 if name == which else 0).cast("long").alias(name) for name in tables])

    names = list(tables)
    per_owner = reduce(DataFrame.unionByName, [counts(df, n) for n, df in tables.items()]) \
        .groupBy("owner_id").agg(*[F.sum(n).alias(n) for n in names])
    zero = F.lit(0).cast("long")
    readable = granted.join(per_owner, "owner_id", "left").select(
        "viewer_id", *[F.coalesce(n, zero).alias(n) for n in names], zero.alias("shares"))
    ends = shares.select(
        F.explode(F.array_distinct(F.array("owner_id", "viewer_id"))).alias("viewer_id"),
        *[zero.alias(n) for n in names], F.lit(1).cast("long").alias("shares"))
    return readable.unionByName(ends).groupBy("viewer_id") \
        .agg(*[F.sum(n).alias(n) for n in [*names, "shares"]])


def shared_template(activities: DataFrame, granted: DataFrame,
                    viewers: DataFrame) -> DataFrame:
    """The signed-in view of somebody else's template: recurring rows only."""
    others = granted.where(F.col("viewer_id") != F.col("owner_id"))
    return visible_to(recurring(activities), others, viewers)


def with_permission(edits: DataFrame, granted: DataFrame, own_only: bool = False) -> DataFrame:
    """Whether the author of each edit may write its owner's rows.

    Owners may, and those they gave ``edit``. Shares and profiles are for
    their owner alone (``own_only``). ``edits`` names the writer ``author_id``.
    """
    own = F.col("author_id") == F.col("owner_id")
    if own_only:
        return edits.withColumn("permitted", F.coalesce(own, F.lit(False)))
    editors = editable(granted).where(F.col("viewer_id") != F.col("owner_id")).select(
        F.col("viewer_id").alias("author_id"), "owner_id", F.lit(True).alias("_may")).distinct()
    joined = edits.join(editors, ["author_id", "owner_id"], "left")
    return joined.select(*edits.columns,
                         F.coalesce(own | F.col("_may"), F.lit(False)).alias("permitted"))
