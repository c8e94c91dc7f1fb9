"""The pages as tables, for all owners and periods at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions import dates as D
from ..model import Horizon
from ..operators import adherence, goals as G, occurrences as O
from ..operators.reflections import with_reflection


def week_report(profiles, activities, logs, reflections, horizon: Horizon,
                as_of: dt.date) -> DataFrame:
    """Adherence per week with its caption and the owner's reflection on it."""
    weeks = adherence.week_adherence(profiles, activities, logs, horizon)
    start = F.col("week_start")
    offset = D.weeks_from(F.lit(as_of), start)
    return with_reflection(weeks, reflections, "weekly", start, "reflection").withColumns({
        "caption": D.offset_label(offset, "week"),
        "first_day": D.short_label(start), "last_day": D.short_label(F.date_add(start, 6))})


def month_report(profiles, activities, logs, reflections, horizon: Horizon,
                 as_of: dt.date) -> DataFrame:
    months = adherence.month_adherence(profiles, activities, logs, horizon)
    start = F.col("month_start")
    offset = D.months_from(F.lit(as_of), start)
    return with_reflection(months, reflections, "monthly", start, "reflection").withColumns({
        "caption": D.offset_label(offset, "month"), "month_name": D.month_label(start)})


def day_detail(activities, logs, goals, horizon: Horizon, as_of: dt.date) -> DataFrame:
    """The agenda rows of any day, as listed on its page.

    Days after ``as_of`` are plans: done marks are not shown for them.
    """
    listed = O.agenda(O.with_goal_titles(activities, goals), logs, horizon)
    start, end = F.col("actual_start_min"), F.col("actual_end_min")
    some_actual = start.isNotNull() | end.isNotNull()
    future = F.col("d") > F.lit(as_of)
    return listed.select(
        "owner_id", "d", "activity_id", "title", "category", "sort_order", "one_off",
        "goal_title", future.alias("is_future"),
        F.when(~future, F.col("completed")).alias("completed"),
        F.concat(F.lit("Planned "), C.hhmm_or_dash(F.col("planned_start_min")), F.lit("–"),
                 C.hhmm_or_dash(F.col("planned_end_min")),
                 F.when(some_actual, F.concat(F.lit(" · actual "), C.hhmm_or_dash(start),
                                              F.lit("–"), C.hhmm_or_dash(end)))
                 .otherwise("")).alias("times"),
        C.span_minutes(start, end).alias("minutes"), "note")


def today_list(activities, logs, goals, as_of: dt.date) -> DataFrame:
    return day_detail(activities, logs, goals, Horizon(as_of, as_of), as_of)


def goals_report(goals, activities, logs, as_of: dt.date) -> DataFrame:
    """Every goal in its current period, with bar and caption."""
    return G.goal_labels(G.goals_at(goals, activities, logs, as_of)).withColumn(
        "caption", F.concat(
            F.col("label"), F.lit(" ("), F.col("pct").cast("string"), F.lit("%) · this "),
            F.when(F.col("period_type") == "weekly", "week").otherwise("month")))
