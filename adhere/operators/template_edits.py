"""Adding, changing, ordering and removing activities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DAY_TYPES, DEFAULT_CATEGORY, DEFAULT_ROUTINE
from ..functions import dates as D
from ..functions.clock import parse_hhmm
from ..functions.names import blank_to_null, page_trim
from ..functions.rows import several_rows
from ..model import TARGET_TYPE
from ..sources.readers import one_offs, recurring
from .ranking import with_positions


def clean_category(text: Column) -> Column:
    return F.coalesce(blank_to_null(page_trim(text)), F.lit(DEFAULT_CATEGORY))


def clean_activity_forms(forms: DataFrame) -> DataFrame:
    """Typed input as activity fields; a blank title rejects the form."""
    title = page_trim(F.col("title"))
    return forms.where(title != "").withColumns({
        "title": title,
        "category": clean_category(F.col("category")),
        "planned_start_min": parse_hhmm(F.col("planned_start")),
        "planned_end_min": parse_hhmm(F.col("planned_end")),
        "goal_id": blank_to_null(F.col("goal_id")).try_cast("long"),
        "color": blank_to_null(F.col("color"))}).drop("planned_start", "planned_end")


def clean_goal_forms(forms: DataFrame) -> DataFrame:
    """Named goals with a finite target above zero; the rest are rejected.

    The target is judged as it is stored: up to 28 digits before the point and 10
    behind it. So none that is accepted turns to null or zero afterwards.
    """
    title, target = page_trim(F.col("title")), F.trim("target").try_cast(TARGET_TYPE)
    return forms.where(title != "").withColumns({"title": title, "target": target}).where(
        F.col("target") > 0)


def place_one_offs(new: DataFrame, activities: DataFrame) -> DataFrame:
    """Give new one-offs positions after everything on their day's agenda.

    The agenda's highest position is the higher of two small aggregates: the
    owner's template for the day type and the one-offs of the date.
    """
    template = recurring(activities).groupBy("owner_id", "day_type") \
        .agg(F.max("sort_order").alias("_template_top"))
    singles = one_offs(activities).groupBy("owner_id", "entry_date") \
        .agg(F.max("sort_order").alias("_single_top"))
    numbered = with_positions(
        new.withColumn("day_type", D.day_type(F.col("entry_date"))),
        ["owner_id", "entry_date"], [F.col("created_at"), F.col("seq")], "_pos")
    top = F.greatest(F.coalesce("_template_top", F.lit(0)),
                     F.coalesce("_single_top", F.lit(0)), F.lit(0))
    return (numbered.join(template, ["owner_id", "day_type"], "left")
            .join(singles, ["owner_id", "entry_date"], "left")
            .withColumn("sort_order", (top + 1 + F.col("_pos")).cast("int"))
            .drop("_pos", "_template_top", "_single_top"))


def place_in_template(new: DataFrame, activities: DataFrame) -> DataFrame:
    """Give new recurring rows positions after their day type's template."""
    top = recurring(activities).groupBy("owner_id", "day_type") \
        .agg(F.max("sort_order").alias("_top"))
    numbered = with_positions(
        new, ["owner_id", "day_type"], [F.col("created_at"), F.col("seq")], "_pos")
    return (numbered.join(top, ["owner_id", "day_type"], "left")
            .withColumn("sort_order", (F.greatest(F.coalesce("_top", F.lit(0)), F.lit(0))
                                       + 1 + F.col("_pos")).cast("int"))
            .drop("_pos", "_top"))


def seed_defaults(profiles: DataFrame, activities: DataFrame) -> DataFrame:
    """The default routine for every owner who has no activity at all.

    Running it again adds nothing for owners seeded before. The routine is a
    constant array that is unnested per owner; nothing is joined to it.
    """
    bare = profiles.join(activities.select("owner_id"), "owner_id", "left_anti")
    rows = several_rows(*[
        dict(title=F.lit(title), day_type=F.lit(day_type),
             planned_start_min=parse_hhmm(F.lit(start)), planned_end_min=parse_hhmm(F.lit(end)),
             category=F.lit(category), sort_order=F.lit(position))
        for title, day_type, start, end, category, position in DEFAULT_ROUTINE])
    return bare.select("owner_id", rows).withColumn("activity_id", F.concat(
        F.col("owner_id").cast("string"), F.lit(":default:"), F.col("day_type"), F.lit(":"),
        F.col("sort_order").cast("string")))


def moved_position(position: Column, origin: Column, target: Column) -> Column:
    """Where a row ends up when the row at ``origin`` is dropped at ``target``.

    The move shifts the rows between both places by one, so each row's new
    place follows from its old one and nothing has to be sorted again.
    """
    return (F.when(position == origin, target)
            .when((position > origin) & (position <= target), position - 1)
            .when((position < origin) & (position >= target), position + 1)
            .otherwise(position))


def list_positions(activities: DataFrame, lists: DataFrame) -> DataFrame:
    """Each entry's place in the day's lists asked for as (owner_id, d).

    A day's list holds the template of its day type and the one-offs of the date,
    in one order. Adds d, position and list_size.
    """
    wanted = lists.select("owner_id", "d").distinct().withColumn(
        "day_type", D.day_type(F.col("d")))
    template = recurring(activities).join(wanted, ["owner_id", "day_type"])
    singles = one_offs(activities).join(
        wanted.select("owner_id", F.col("d").alias("entry_date"), "d"), ["owner_id", "entry_date"])
    order = [F.col("sort_order"), F.col("created_at"), F.col("activity_id")]
    columns = ["owner_id", "d", "activity_id", "sort_order", "created_at"]
    return with_positions(template.select(columns).unionByName(singles.select(columns)),
                          ["owner_id", "d"], order, "position", size="list_size")


def reorder_changes(activities: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows whose ``sort_order`` changes by the moves made in day lists.

    ``moves`` holds (owner_id, d, seq, from_index, to_index); those of a list
    apply one after the other by ``seq``. The whole list is renumbered from 0 and
    only changed rows come out. A move to the same place, or from or to a place
    outside the list, does nothing.
    """
    made = moves.groupBy("owner_id", "d").agg(F.array_sort(F.collect_list(
        F.struct("seq", "from_index", "to_index"))).alias("_moves"))
    listed = list_positions(activities, moves).join(made, ["owner_id", "d"])
    size = F.col("list_size")

    def counts(move: Column) -> Column:
        return (move["from_index"].between(0, size - 1) & move["to_index"].between(0, size - 1)
                & (move["from_index"] != move["to_index"]))

    fresh = F.aggregate(
        F.filter("_moves", counts), F.col("position"),
        lambda at, move: moved_position(at, move["from_index"].cast("long"),
                                        move["to_index"].cast("long"))).cast("int")
    return (listed.where(F.exists("_moves", counts))
            .select("owner_id", "d", "activity_id", F.col("sort_order").alias("old_sort_order"),
                    fresh.alias("sort_order"))
            .where(F.col("sort_order") != F.col("old_sort_order")))


# Which mask column of an activity patch governs which fields.
ACTIVITY_PATCH_FIELDS = {
    "title": "sets_title",
    "category": "sets_category",
    "color": "sets_color",
    "goal_id": "sets_goal",
    "day_type": "sets_day_type",
    "planned_start_min": "sets_times",
    "planned_end_min": "sets_times",
}


def typed_activity_patches(patches: DataFrame) -> DataFrame:
    """Patches as typed, with the fields converted.

    A blank title says nothing, a blank category means the default; a blank
    color, goal or time clears its field; a day type that is none says nothing.
    """
    title = blank_to_null(page_trim(F.col("title")))
    return patches.withColumns({
        "sets_title": F.col("sets_title") & title.isNotNull(), "title": title,
        "category": clean_category(F.col("category")),
        "color": blank_to_null(F.col("color")),
        "goal_id": blank_to_null(F.col("goal_id")).try_cast("long"),
        "sets_day_type": F.col("sets_day_type") & F.col("day_type").isin(*DAY_TYPES),
        "planned_start_min": parse_hhmm(F.col("planned_start")),
        "planned_end_min": parse_hhmm(F.col("planned_end"))})


def activity_changes(activities: DataFrame, patches: DataFrame) -> DataFrame:
    """What edits of single fields really change, one row per changed activity.

    ``patches`` holds any number of patches per activity, each with masks for the
    fields it sets (``ACTIVITY_PATCH_FIELDS``). Per field the newest patch by
    (ts, seq) that sets it wins, a null it sets is a value, and fields that no
    patch sets keep theirs. Unchanged activities do not come out.
    """
    fields = list(ACTIVITY_PATCH_FIELDS)
    words = typed_activity_patches(patches).groupBy("activity_id").agg(*[
        F.max(F.when(F.col(mask), F.struct("ts", "seq", F.col(field).alias("value"))))
        .alias(f"_{field}") for field, mask in ACTIVITY_PATCH_FIELDS.items()])
    both = activities.select("activity_id", *[F.col(f).alias(f"old_{f}") for f in fields]) \
        .join(words, "activity_id").select(
        "activity_id", *[f"old_{f}" for f in fields],
        *[F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value"))
          .otherwise(F.col(f"old_{f}")).alias(f) for f in fields])
    same = reduce(lambda a, b: a & b, [F.col(f"old_{f}").eqNullSafe(F.col(f)) for f in fields])
    return both.where(~same)
