"""Goals and what was achieved toward them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions import dates as D
from ..functions import progress as P
from ..model import Horizon


def _wide(h: Horizon) -> Horizon:
    weeks, months = h.widened_to_weeks(), h.widened_to_months()
    return Horizon(min(weeks.start, months.start), max(weeks.end, months.end))


def goal_periods(goals: DataFrame, horizon: Horizon) -> DataFrame:
    """Each goal with the start of each of its periods that touch the horizon."""
    first, last = F.lit(horizon.start), F.lit(horizon.end)
    starts = F.when(F.col("period_type") == "weekly", D.weeks_touching(first, last)) \
        .otherwise(D.months_touching(first, last))
    return goals.withColumn("period_start", F.explode(starts))


def goal_gains(goals: DataFrame, activities: DataFrame, logs: DataFrame,
               horizon: Horizon) -> DataFrame:
    """(goal_id, period_start, log_date, gained): completions or minutes per goal and day.

    The period is derived from the log's date, so the date range of a goal is
    an equality and no range join is needed. A log counts only for goals of
    its own owner.
    """
    return _gains(goals, activities, logs, horizon).groupBy(
        "goal_id", "period_start", "log_date").agg(F.sum("gained").alias("gained"))


def _gains(goals: DataFrame, activities: DataFrame, logs: DataFrame, horizon: Horizon) -> DataFrame:
    wide = _wide(horizon)
    d, start, end = F.col("log_date"), F.col("actual_start_min"), F.col("actual_end_min")
    tagged = (activities.where(F.col("goal_id").isNotNull()).select("activity_id", "goal_id")
              .join(goals.select("goal_id", "owner_id", "period_type", "metric"), "goal_id"))
    facts = logs.where(d.between(wide.start, wide.end)
                       & (F.col("completed") | C.valid_span(start, end))) \
        .select("owner_id", "activity_id", "log_date", "completed",
                "actual_start_min", "actual_end_min")
    gained = F.when(F.col("metric") == "count", F.col("completed").cast("long")) \
        .otherwise(C.span_minutes(start, end))
    return facts.join(tagged, ["owner_id", "activity_id"]).select(
        "goal_id", D.period_start(F.col("period_type"), d).alias("period_start"), "log_date",
        F.coalesce(gained, F.lit(0)).alias("gained"))


def goal_actuals(goals: DataFrame, activities: DataFrame, logs: DataFrame,
                 horizon: Horizon) -> DataFrame:
    """Completions or minutes per goal and period that has any (see ``goal_gains``)."""
    return _gains(goals, activities, logs, horizon).groupBy(
        "goal_id", "period_start").agg(F.sum("gained").alias("actual"))


def goal_progress(goals: DataFrame, activities: DataFrame, logs: DataFrame,
                  horizon: Horizon) -> DataFrame:
    """Every goal and period, including those without any log."""
    actuals = goal_actuals(goals, activities, logs, horizon)
    out = goal_periods(goals, horizon).join(actuals, ["goal_id", "period_start"], "left") \
        .withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.withColumn(
        "pct", P.goal_percent(F.col("actual"), F.col("metric"), F.col("target")))


def goal_labels(progress: DataFrame) -> DataFrame:
    """The caption under each goal's bar."""
    return progress.withColumns({
        "target_unit": P.goal_target_unit(F.col("metric"), F.col("target")),
        "label": P.goal_label(F.col("actual"), F.col("metric"), F.col("target"))})


def goals_at(goals: DataFrame, activities: DataFrame, logs: DataFrame,
             as_of: dt.date) -> DataFrame:
    """Progress in the current week or month of each goal."""
    return goal_progress(goals, activities, logs, Horizon(as_of, as_of))
