"""What the pages show on every day of a horizon, as if each day were "today": one job for all days.

A page seen on a day shows the week and the month around that day. Between two borders of
weeks and months all days show the same totals, calendar and goal sums, so these are put
together once per *span* of days that share a week and a month (at most seven
spans a month), beside the day's own list and text, in one aggregation per owner and span.
Days are expanded after it. Besides the totals of whole periods, ``goals_by_day`` and
``totals_to_date`` give what had been reached by the end of each day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import progress as P
from ..functions.private import hide_blocks
from ..model import Horizon
from ..operators import adherence, goals as G
from . import publish


def spans(horizon: Horizon) -> list[tuple[dt.date, dt.date, dt.date, dt.date]]:
    """(week start, month start, first day, last day) of the runs of days that share a week and a month."""
    found: dict[tuple[dt.date, dt.date], list[dt.date]] = {}
    for k in range((horizon.end - horizon.start).days + 1):
        d = horizon.start + dt.timedelta(days=k)
        found.setdefault((d - dt.timedelta(days=d.weekday()), d.replace(day=1)), []).append(d)
    return [(*key, days[0], days[-1]) for key, days in found.items()]


def _spans(horizon: Horizon) -> Column:
    """All spans as an array of structs."""
    return F.array(*[F.struct(F.lit(w).alias("week_start"), F.lit(m).alias("month_start"),
                              F.lit(a).alias("first"), F.lit(b).alias("last"))
                     for w, m, a, b in spans(horizon)])


def _wide(h: Horizon) -> Horizon:
    weeks, months = h.widened_to_weeks(), h.widened_to_months()
    return Horizon(min(weeks.start, months.start), max(weeks.end, months.end))


def goals_by_day(goals: DataFrame, activities: DataFrame, logs: DataFrame, horizon: Horizon) -> DataFrame:
    """Every goal on every day: its period, what the whole period reached (``actual``, as a page of that
    day shows it), and what was reached by the end of the day (``so_far``), with percentages and captions.

    Gains are summed per goal and day before they are packed per period (31 entries at most), and days
    are expanded after the join.
    """
    wide = _wide(horizon)
    gains = G.goal_gains(goals, activities, logs, wide).groupBy("goal_id", "period_start").agg(
        F.collect_list(F.struct("log_date", "gained")).alias("gains"))
    period_end = D.period_end(F.col("period_type"), F.col("period_start"))
    days = D.days_between(F.greatest(F.col("period_start"), F.lit(horizon.start)),
                          F.least(period_end, F.lit(horizon.end)))

    def total(until: Column | None) -> Column:
        zero = F.lit(0).cast("long")
        return F.coalesce(F.aggregate("gains", zero, lambda sum_, g: sum_ + F.when(
            F.lit(True) if until is None else g["log_date"] <= until, g["gained"]).otherwise(zero)), zero)

    rows = G.goal_periods(goals, horizon).join(gains, ["goal_id", "period_start"], "left").withColumn(
        "actual", total(None)).withColumn("d", F.explode(days)).withColumn("so_far", total(F.col("d"))).drop("gains")
    metric, target = F.col("metric"), F.col("target")
    label = P.goal_label(F.col("actual"), metric, target)
    pct = P.goal_percent(F.col("actual"), metric, target)
    return rows.withColumns({
        "period_end": period_end, "pct": pct, "pct_so_far": P.goal_percent(F.col("so_far"), metric, target),
        "caption": F.concat(label, F.lit(" ("), pct.cast("string"), F.lit("%) · this "),
                            F.when(F.col("period_type") == "weekly", "week").otherwise("month"))})


def totals_to_date(profiles: DataFrame, activities: DataFrame, logs: DataFrame, horizon: Horizon) -> DataFrame:
    """Planned and done of every owner by the end of every day, since its week and its month began.

    The calendar keeps an owner's days in one partition, which serves both running sums; an owner has one row a
    day there.
    """
    days = adherence.calendar_days(profiles, activities, logs, _wide(horizon)).select(
        "owner_id", "d", "planned", "done", D.week_start(F.col("d")).alias("week_start"),
        D.month_start(F.col("d")).alias("month_start"))
    out = days
    for name in ("week", "month"):
        period = W.partitionBy("owner_id", f"{name}_start")
        to_date = period.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumns({f"{name}_{c}_to_date": F.sum(c).over(to_date) for c in ("planned", "done")})
        out = out.withColumns({f"{name}_{c}": F.sum(c).over(period) for c in ("planned", "done")})
        out = out.withColumn(f"{name}_pct_to_date", P.percent(
            F.col(f"{name}_done_to_date"), F.col(f"{name}_planned_to_date")))
    return out.where(F.col("d").between(horizon.start, horizon.end)).drop("planned", "done")


def progress_by_day(profiles: DataFrame, activities: DataFrame, logs: DataFrame, goals: DataFrame,
                    reflections: DataFrame, horizon: Horizon, part_size: int = publish.PART_SIZE) -> DataFrame:
    """The progress page of every owner with a code on every day of the horizon.

    Columns are those of ``publish.public_progress`` and the day ``d``; each day's documents equal its.
    """
    people = publish._people(profiles)
    who = F.struct("share_code", "owner_name").alias("who")
    zero = F.lit(0).alias("part_no")
    keys = ["owner_id", "part_no", "week_start", "month_start"]

    def spread(df: DataFrame) -> DataFrame:
        """Rows once for each span."""
        return df.withColumn("span", F.explode(_spans(horizon))).select(
            "*", "span.week_start", "span.month_start").drop("span")

    wide, at, kind = _wide(horizon), F.col("period_date"), F.col("period_type")
    texts = reflections.join(people.select("owner_id"), "owner_id", "left_semi").where(
        (at == D.period_start(kind, at)) & at.between(wide.start, wide.end)).groupBy("owner_id").agg(*[
            F.collect_list(F.when(kind == p, F.struct(at.alias("d"), hide_blocks(F.col("content")).alias("text")))).alias(name)
            for p, name in (("weekly", "_weeklies"), ("monthly", "_monthlies"), ("daily", "dailies"))])
    numbered = publish._numbered_goals(goals.join(people.select("owner_id"), "owner_id"), part_size)
    actuals = G.goal_actuals(goals, activities, logs, horizon)
    goal_rows = spread(numbered).withColumn("period_start", F.when(
        F.col("period_type") == "weekly", F.col("week_start")).otherwise(F.col("month_start"))).join(
        actuals, ["goal_id", "period_start"], "left")
    goal = F.struct("title", F.col("period_type").alias("period"), "metric",
                    F.col("target").cast("double").alias("target"),
                    F.coalesce("actual", F.lit(0)).alias("actual"))
    items = publish._agenda_items(activities, logs, people, horizon, part_size).select(
        "owner_id", "part_no", D.week_start(F.col("d")).alias("week_start"),
        D.month_start(F.col("d")).alias("month_start"),
        F.struct("d", "item", "part_count").alias("today"))
    pieces = [
        spread(people.select("owner_id", who, zero)), items,
        goal_rows.select(*keys, F.col("part_count").alias("goal_parts"),
                         F.struct("created_at", "goal_id", goal.alias("shown")).alias("goal"))]
    merged = publish._merged(pieces, keys, {
        "who": F.max("who"), "items": F.collect_list("today"),
        "goals": publish._in_order(F.col("goal")), "goal_parts": F.max("goal_parts")})
    # The name stands on part 0; parts further on take it from the owner. An owner's days and texts come beside it,
    # packed once; as rows of every span that shows them they would be most of what is shuffled.
    days = adherence.calendar_days(people, activities, logs, wide).groupBy("owner_id").agg(
        F.array_sort(F.collect_list(F.struct("d", "planned", "done"))).alias("days"))
    owners = people.select("owner_id", who).join(days, "owner_id").join(texts, "owner_id", "left")
    merged = merged.drop("who").join(owners, "owner_id")
    on_first = F.col("part_no") == 0
    none = F.lit(None).cast("string")

    def text_at(name: str, start: str) -> Column:
        """The text of a period, on part 0; the greatest if there are several, null if there is none."""
        return F.when(on_first, F.array_max(F.transform(
            F.filter(name, lambda x: x["d"] == F.col(start)), lambda x: x["text"]))).otherwise(none)

    merged = merged.withColumns({
        "days": F.when(on_first, F.col("days")).otherwise(F.slice("days", 1, 0)),
        "weekly": text_at("_weeklies", "week_start"), "monthly": text_at("_monthlies", "month_start"),
        "dailies": F.when(on_first, F.filter("dailies", lambda x: (D.week_start(x["d"]) == F.col("week_start"))
                                             & (D.month_start(x["d"]) == F.col("month_start"))))}
    ).drop("_weeklies", "_monthlies")

    week, month = F.col("week_start"), F.col("month_start")

    def total(inside) -> Column:
        days = F.filter("days", lambda x: inside(x["d"]))
        return F.when(F.size(days) > 0, F.struct(*[F.aggregate(
            days, F.lit(0).cast("long"), lambda n, x: n + x[c]).alias(c) for c in ("done", "planned")]))

    empty = F.struct(F.lit(None).cast("long").alias("done"), F.lit(None).cast("long").alias("planned"))
    calendar = F.transform(F.filter("days", lambda x: D.month_start(x["d"]) == month), lambda x: F.struct(
        D.iso_date(x["d"]).alias("d"), x["planned"].alias("planned"), x["done"].alias("done")))
    first, last = F.greatest(week, month, F.lit(horizon.start)), F.least(
        F.date_add(week, 6), D.month_end(month), F.lit(horizon.end))
    by_span = merged.withColumns({
        "week": F.coalesce(total(lambda d: D.week_start(d) == week), empty),
        "month": F.coalesce(total(lambda d: D.month_start(d) == month), empty), "calendar": calendar})
    rows = by_span.withColumn("d", F.explode(D.days_between(first, last)))
    own = F.filter("items", lambda x: x["d"] == F.col("d"))
    rows = rows.withColumn("own", own).where(
        (F.col("part_no") == 0) | (F.size("goals") > 0) | (F.size("own") > 0))
    today = F.transform(F.array_sort(F.transform("own", lambda x: x["item"])), lambda e: e["shown"])
    daily = F.try_element_at(F.transform(
        F.filter("dailies", lambda x: x["d"] == F.col("d")), lambda x: x["text"]), F.lit(1))
    parts = F.greatest(F.lit(1), "goal_parts", F.array_max(F.transform("own", lambda x: x["part_count"])))
    return rows.select("owner_id", F.col("who.share_code"), "d", "part_no", parts.alias("part_count"), F.struct(
        F.col("who.owner_name"), today.alias("today"), "week", "month", "calendar", "goals",
        F.struct(daily.alias("daily"), "weekly", "monthly").alias("reflections")).alias("document"))
