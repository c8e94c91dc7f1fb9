"""Which activities are planned on which days, and what was logged for them.

A recurring activity is planned on every day of its day type; a one-off only
on its entry date. Today's template is applied to past days as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..model import Horizon
from ..sources.readers import in_horizon, one_offs, recurring


def _first(h: Horizon) -> Column:
    return F.lit(h.start)


def _last(h: Horizon) -> Column:
    return F.lit(h.end)


def is_planned(d: Column) -> Column:
    """Whether an activity row is on the agenda of day ``d``."""
    return F.when(F.col("entry_date").isNull(), F.col("day_type") == D.day_type(d)) \
        .otherwise(F.col("entry_date") == d)


def occurrences(activities: DataFrame, horizon: Horizon) -> DataFrame:
    """One row per planned (owner, activity, day): two disjoint branches."""
    kept = [c for c in activities.columns]
    days = D.days_between(_first(horizon), _last(horizon))
    repeated = (recurring(activities).select(*kept, F.explode(days).alias("d"))
                .where(F.col("day_type") == D.day_type(F.col("d"))))
    single = one_offs(activities, horizon).withColumn("d", F.col("entry_date"))
    return repeated.unionByName(single)


def with_goal_titles(activities: DataFrame, goals: DataFrame) -> DataFrame:
    """Title of the goal each activity counts toward, among the owner's own."""
    titles = goals.select("goal_id", "owner_id", F.col("title").alias("goal_title"))
    return activities.join(titles, ["goal_id", "owner_id"], "left")


def agenda(activities: DataFrame, logs: DataFrame, horizon: Horizon) -> DataFrame:
    """Planned occurrences with their log, if any.

    The days are expanded after the shuffle, not before it: activities travel
    once per month and meet their logs of that month packed into one map. The
    key of ``logs`` allows one row per activity and day, so a map holds at
    most 31 entries. A table that breaks its key fails here; read it with
    ``read_logs(newest_only=True)`` then, which serves ``planned_logs`` as well.
    """
    months = D.months_touching(_first(horizon), _last(horizon))
    plans = recurring(activities).withColumn("_month", F.explode(months)).unionByName(
        one_offs(activities, horizon)
        .withColumn("_month", D.month_start(F.col("entry_date"))))
    facts = F.struct("completed", "actual_start_min", "actual_end_min", "note")
    packed = (in_horizon(logs, "log_date", horizon)
              .groupBy("owner_id", "activity_id",
                       D.month_start(F.col("log_date")).alias("_month"))
              .agg(F.map_from_entries(F.collect_list(F.struct(F.col("log_date"), facts)))
                   .alias("_logs")))
    month_days = F.sequence(F.greatest(F.col("_month"), _first(horizon)),
                            F.least(F.last_day("_month"), _last(horizon)))
    days = F.when(F.col("entry_date").isNull(), month_days) \
        .otherwise(F.array("entry_date"))
    joined = plans.join(packed, ["owner_id", "activity_id", "_month"], "left")
    expanded = (joined.withColumn("d", F.explode(days))
                .where(F.col("entry_date").isNotNull()
                       | (F.col("day_type") == D.day_type(F.col("d"))))
                .withColumn("_log", F.try_element_at("_logs", F.col("d"))))
    return expanded.select(
        *activities.columns, "d",
        F.col("entry_date").isNotNull().alias("one_off"),
        F.col("_log").isNotNull().alias("logged"),
        F.coalesce("_log.completed", F.lit(False)).alias("completed"),
        "_log.actual_start_min", "_log.actual_end_min", "_log.note")


def planned_logs(activities: DataFrame, logs: DataFrame, horizon: Horizon) -> DataFrame:
    """Only the logs that stand on their day's agenda, with the activity.

    Reports that ignore days without a log start here and never expand days.
    """
    facts = in_horizon(logs, "log_date", horizon)
    plan = activities.select("owner_id", "activity_id", "day_type", "entry_date",
                             "category")
    return (facts.join(plan, ["owner_id", "activity_id"])
            .where(is_planned(F.col("log_date"))))
