"""Planned versus done: per day, week and month.

All of these add up rows of three origins (the plan, one-offs, completed logs)
under one key, in one shuffle with partial sums in front of it. No join is
needed and a busy owner costs one row per key and task.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions import dates as D
from ..functions import progress as P
from ..model import Horizon
from ..sources.readers import one_offs, recurring
from .occurrences import planned_logs


def plan_counts(profiles: DataFrame, activities: DataFrame) -> DataFrame:
    """Recurring activities of every owner by day type; zero without a plan."""
    def counted(day_type: str) -> Column:
        return F.when(F.col("day_type") == day_type, 1).otherwise(0).cast("long")

    none = F.lit(0).cast("long")
    rows = (profiles.select("owner_id", none.alias("_wd"), none.alias("_we"),
                            F.lit(True).alias("_known"))
            .unionByName(recurring(activities).select(
                "owner_id", counted("weekday").alias("_wd"),
                counted("weekend").alias("_we"), F.lit(False).alias("_known"))))
    return (rows.groupBy("owner_id")
            .agg(F.sum("_wd").alias("weekday_n"), F.sum("_we").alias("weekend_n"),
                 F.max("_known").alias("_known"))
            .where("_known").drop("_known"))


def _rows(df: DataFrame, key: str, at: Column, planned, done, known: bool) -> DataFrame:
    return df.select("owner_id", at.alias(key), F.lit(planned).cast("long").alias("planned"),
                     F.lit(done).cast("long").alias("done"), F.lit(known).alias("_known"))


def _added_up(parts: list[DataFrame], key: str) -> DataFrame:
    """Sum the parts; keys without a plan row (foreign owners) are left out."""
    return (reduce(DataFrame.unionByName, parts).groupBy("owner_id", key)
            .agg(F.sum("planned").alias("planned"), F.sum("done").alias("done"),
                 F.max("_known").alias("_known"))
            .where("_known").drop("_known"))


def _done(logs: DataFrame, h: Horizon) -> DataFrame:
    return logs.where(F.col("completed") & F.col("log_date").between(h.start, h.end))


def _on_days(plans: DataFrame, parts: list[DataFrame], sums: list[str], horizon: Horizon) -> DataFrame:
    """Every owner of ``plans`` on every day of the horizon, with the ``sums`` of that day's rows in ``parts``.

    An owner's days with rows (at most those of the horizon) are packed beside its plan before days are
    expanded, so the expanded rows are neither hashed, sorted nor shuffled here. The packed rows are a small part of
    them; with their number of partitions left to their size, a few tasks would expand all. Owners without a plan
    row are left out. Rows of an owner stay in one partition.
    """
    parts_wanted = int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_day = reduce(DataFrame.unionByName, parts).groupBy("owner_id", "d").agg(
        *[F.sum(c).alias(c) for c in sums])
    stacked = plans.withColumn("_known", F.lit(True)).unionByName(
        by_day.select("owner_id", F.struct("d", F.struct(*sums).alias("sums")).alias("_day")), allowMissingColumns=True)
    packed = stacked.repartition(parts_wanted, "owner_id").groupBy("owner_id").agg(
        *[F.max(c).alias(c) for c in ("weekday_n", "weekend_n", "_known")],
        F.map_from_entries(F.collect_list("_day")).alias("_days")).where("_known")
    days = packed.select("owner_id", "weekday_n", "weekend_n", "_days", F.explode(
        D.days_between(F.lit(horizon.start), F.lit(horizon.end))).alias("d"))
    own = F.try_element_at("_days", F.col("d"))
    on_day = F.when(D.day_type(F.col("d")) == "weekend", F.col("weekend_n")).otherwise(F.col("weekday_n"))
    return days.select("owner_id", "d", on_day.alias("_on_day"), *[
        F.coalesce(own[c], F.lit(0).cast("long")).alias(c) for c in sums])


def calendar_days(profiles: DataFrame, activities: DataFrame, logs: DataFrame,
                  horizon: Horizon) -> DataFrame:
    """Planned and done of every owner on every day of the horizon."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    out = _on_days(plan_counts(profiles, activities), [
        one_offs(activities, horizon).select(
            "owner_id", F.col("entry_date").alias("d"), one.alias("planned"), none.alias("done")),
        _done(logs, horizon).select(
            "owner_id", F.col("log_date").alias("d"), none.alias("planned"), one.alias("done"))],
        ["planned", "done"], horizon)
    return out.select("owner_id", "d", (F.col("_on_day") + F.col("planned")).alias("planned"), "done").withColumns({
        "day_type": D.day_type(F.col("d")),
        "level": P.heat_level(F.col("done"), F.col("planned"))})


def week_adherence(profiles: DataFrame, activities: DataFrame, logs: DataFrame,
                   horizon: Horizon) -> DataFrame:
    """Whole weeks (Monday first) that touch the horizon."""
    wide = horizon.widened_to_weeks()
    weeks = plan_counts(profiles, activities).select(
        "owner_id", F.explode(D.weeks_touching(F.lit(wide.start), F.lit(wide.end)))
        .alias("week_start"),
        (F.col("weekday_n") * 5 + F.col("weekend_n") * 2).alias("_planned"))
    return _added_up([
        _rows(weeks, "week_start", F.col("week_start"), F.col("_planned"), 0, True),
        _rows(one_offs(activities, wide), "week_start",
              D.week_start(F.col("entry_date")), 1, 0, False),
        _rows(_done(logs, wide), "week_start", D.week_start(F.col("log_date")), 0, 1, False)],
        "week_start").withColumn("pct", P.percent(F.col("done"), F.col("planned")))


def month_adherence(profiles: DataFrame, activities: DataFrame, logs: DataFrame,
                    horizon: Horizon) -> DataFrame:
    """Whole months that touch the horizon."""
    wide = horizon.widened_to_months()
    month = F.col("month_start")
    months = plan_counts(profiles, activities).select(
        "owner_id", F.explode(D.months_touching(F.lit(wide.start), F.lit(wide.end)))
        .alias("month_start"), "weekday_n", "weekend_n")
    planned = (F.col("weekday_n") * D.weekdays_in(month, D.month_end(month))
               + F.col("weekend_n") * D.weekends_in(month, D.month_end(month)))
    return _added_up([
        _rows(months, "month_start", month, planned, 0, True),
        _rows(one_offs(activities, wide), "month_start",
              D.month_start(F.col("entry_date")), 1, 0, False),
        _rows(_done(logs, wide), "month_start", D.month_start(F.col("log_date")), 0, 1,
              False)],
        "month_start").withColumn("pct", P.percent(F.col("done"), F.col("planned")))


def month_grid(calendar: DataFrame) -> DataFrame:
    """Monday-first grid rows; a cell is ``day|done/planned|level`` or null."""
    d = F.col("d")
    cell = F.concat(F.dayofmonth(d).cast("string"), F.lit("|"), F.col("done").cast("string"),
                    F.lit("/"), F.col("planned").cast("string"), F.lit("|"),
                    F.col("level").cast("string"))
    return calendar.groupBy(
        "owner_id", D.month_start(d).alias("month_start"), D.grid_row(d).alias("grid_row")
    ).agg(*[F.max(F.when(D.grid_col(d) == k, cell)).alias(name)
            for k, name in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"])])


def day_tally(profiles: DataFrame, activities: DataFrame, logs: DataFrame,
              horizon: Horizon, as_of: dt.date | None = None) -> DataFrame:
    """Per owner and day: agenda size, how much of it is done, active minutes.

    Only logs on the day's agenda count, unlike the calendar, which counts
    every completed log of the day.
    """
    zero = F.lit(0).cast("long")
    kept = planned_logs(activities, logs, horizon)
    parts = [
        one_offs(activities, horizon).select(
            "owner_id", F.col("entry_date").alias("d"), F.lit(1).cast("long").alias("total"),
            zero.alias("done"), zero.alias("minutes")),
        kept.select("owner_id", F.col("log_date").alias("d"), zero.alias("total"),
                    F.coalesce("completed", F.lit(False)).cast("long").alias("done"),
                    C.span_minutes(F.col("actual_start_min"), F.col("actual_end_min"))
                    .alias("minutes"))]
    out = _on_days(plan_counts(profiles, activities), parts, ["total", "done", "minutes"], horizon).select(
        "owner_id", "d", (F.col("_on_day") + F.col("total")).alias("total"), "done", "minutes")
    tally = F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"),
                     F.lit(" done"))
    if as_of is None:
        return out.withColumn("tally", tally)
    future = F.col("d") > F.lit(as_of)
    return out.withColumns({
        "is_future": future,
        "tally": F.when(future, F.concat(F.col("total").cast("string"), F.lit(" planned")))
        .otherwise(F.concat(tally, F.lit(" · "), C.duration_label(F.col("minutes")),
                            F.lit(" active")))})


def category_minutes(activities: DataFrame, logs: DataFrame, horizon: Horizon) -> DataFrame:
    """Active minutes per owner, day and category; categories without time are absent."""
    start, end = F.col("actual_start_min"), F.col("actual_end_min")
    timed = logs.where(C.valid_span(start, end))
    return (planned_logs(activities, timed, horizon)
            .groupBy("owner_id", F.col("log_date").alias("d"), "category")
            .agg(F.sum(C.span_minutes(start, end)).alias("minutes")))


def period_minutes(logs: DataFrame, horizon: Horizon) -> DataFrame:
    """Active minutes per owner and week and month, whatever the goal."""
    start, end = F.col("actual_start_min"), F.col("actual_end_min")
    d = F.col("log_date")
    weeks, months = horizon.widened_to_weeks(), horizon.widened_to_months()
    wide = Horizon(min(weeks.start, months.start), max(weeks.end, months.end))
    timed = logs.where(C.valid_span(start, end) & d.between(wide.start, wide.end))
    # One partial sum per (week, month) piece first: it serves both periods.
    pieces = timed.groupBy("owner_id", D.week_start(d).alias("_week"),
                           D.month_start(d).alias("_month")) \
        .agg(F.sum(C.span_minutes(start, end)).alias("_minutes"))
    both = pieces.select("owner_id", "_minutes", F.inline(F.array(
        F.struct(F.lit("weekly").alias("period_type"), F.col("_week").alias("period_start")),
        F.struct(F.lit("monthly").alias("period_type"),
                 F.col("_month").alias("period_start")))))
    touched = F.when(F.col("period_type") == "weekly",
                     F.col("period_start").between(weeks.start, weeks.end)) \
        .otherwise(F.col("period_start").between(months.start, months.end))
    return both.where(touched).groupBy("owner_id", "period_type", "period_start") \
        .agg(F.sum("_minutes").alias("minutes"))
