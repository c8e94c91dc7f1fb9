"""Nested documents for public readers.

A document is keyed by owner, or owner and day. Its lists come in parts of at
most ``PART_SIZE`` items, numbered inside the document by one rule for every
size. Each part carries the share code, the owner's name, its number and the
number of parts, so a lookup by code finds every item; the other fields stand on
part 0. Nearly every document has part 0 alone, and an owner with a huge list
neither fills a task nor loses an item.

All pieces of a document meet in one aggregation: each source contributes rows
that fill only its own column, so no finished array is shuffled again.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions import dates as D
from ..functions import names as N
from ..functions.private import hide_blocks
from ..model import Horizon
from ..operators import adherence, goals as G, occurrences as O
from ..operators.ranking import with_positions
from ..operators.reflections import redacted
from ..session import store

PART_SIZE = 1000


def _people(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("share_code").isNotNull()).select(
        "owner_id", "share_code",
        N.owner_name(F.col("display_name"), F.col("username")).alias("owner_name"))


def _in_parts(items: DataFrame, keys: list[str], order: list[str], part_size: int) -> DataFrame:
    """Add ``part_no`` and ``part_count`` of the list each item stands in."""
    placed = with_positions(items, keys, [F.col(c) for c in order], "_pos", size="_size")
    return placed.withColumns({
        "part_no": F.floor(F.col("_pos") / part_size).cast("int"),
        "part_count": F.ceil(F.col("_size") / part_size).cast("int")}).drop("_pos", "_size")


def _short_and_long(rows: DataFrame, part_size: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of owners with at most ``part_size`` of them, and those of the others, if there are any.

    Lists made of the former have one part, so nothing in them needs a number, a sort or a second
    look; whether there are others is the one answer that comes to the driver.
    """
    many = rows.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > part_size).select("owner_id")
    if many.isEmpty():
        return rows, None
    many = store(many, "long-lists")
    return rows.join(many, "owner_id", "left_anti"), rows.join(many, "owner_id", "left_semi")


def _one_part(items: DataFrame) -> DataFrame:
    return items.withColumns({"part_no": F.lit(0), "part_count": F.lit(1)})


def _agenda_items(activities: DataFrame, logs: DataFrame, people: DataFrame,
                  horizon: Horizon, part_size: int) -> DataFrame:
    """(owner_id, d, who, item, part_no, part_count): the item starts with its sort key."""
    kept = activities.where(F.col("entry_date").isNull()
                            | F.col("entry_date").between(horizon.start, horizon.end))
    short, long = _short_and_long(kept, part_size)
    items = _one_part(_listed(short, logs, people, horizon))
    if long is None:
        return items
    return items.unionByName(_in_parts(
        _listed(long, logs, people, horizon), ["owner_id", "d"],
        ["item.sort_order", "item.created_at", "item.activity_id"], part_size))


def _listed(activities: DataFrame, logs: DataFrame, people: DataFrame, horizon: Horizon) -> DataFrame:
    rows = O.agenda(activities.join(people, "owner_id"), redacted(logs, "note"), horizon)
    shown = F.struct(
        "title", "category",
        C.hhmm(F.col("planned_start_min")).alias("planned_start"),
        C.hhmm(F.col("planned_end_min")).alias("planned_end"),
        "completed",
        C.hhmm(F.col("actual_start_min")).alias("actual_start"),
        C.hhmm(F.col("actual_end_min")).alias("actual_end"),
        "note")
    return rows.select("owner_id", "d", F.struct("share_code", "owner_name").alias("who"),
                       F.struct("sort_order", "created_at", "activity_id", shown.alias("shown")).alias("item"))


def _numbered_goals(goals: DataFrame, part_size: int) -> DataFrame:
    short, long = _short_and_long(goals, part_size)
    if long is None:
        return _one_part(short)
    return _one_part(short).unionByName(_in_parts(long, ["owner_id"], ["created_at", "goal_id"], part_size))


def _in_order(items: Column) -> Column:
    """Sorted by the leading key fields, which are then dropped."""
    return F.transform(F.array_sort(F.collect_list(items)), lambda e: e["shown"])


def _merged(pieces: list[DataFrame], keys: list[str], result: dict[str, Column]) -> DataFrame:
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces)
    return stacked.groupBy(*keys).agg(*[c.alias(n) for n, c in result.items()])


def _reflections_of(reflections: DataFrame, period_type: str, at: str, name: str) -> DataFrame:
    return reflections.where(F.col("period_type") == period_type).select(
        "owner_id", F.col("period_date").alias(at),
        hide_blocks(F.col("content")).alias(name))


def _day_heads(people: DataFrame, reflections: DataFrame, horizon: Horizon) -> DataFrame:
    """The fields of every (owner, day) document besides its list.

    Months meet their reflection first, then weeks theirs, then days are
    expanded: a text is joined once per period, not once per day.
    """
    first, last = F.lit(horizon.start), F.lit(horizon.end)
    month = F.col("month_start")
    months = people.withColumn("month_start", F.explode(D.months_touching(first, last))) \
        .join(_reflections_of(reflections, "monthly", "month_start", "month_reflection"),
              ["owner_id", "month_start"], "left")
    opens = F.greatest(month, first)
    closes = F.least(D.month_end(month), last)
    weeks = months.withColumn("week_start", F.explode(D.weeks_touching(opens, closes))) \
        .join(_reflections_of(reflections, "weekly", "week_start", "week_reflection"),
              ["owner_id", "week_start"], "left")
    days = D.days_between(F.greatest(F.col("week_start"), opens),
                          F.least(F.date_add("week_start", 6), closes))
    return weeks.select("owner_id", F.explode(days).alias("d"), F.lit(0).alias("part_no"),
                        F.struct("share_code", "owner_name").alias("who"),
                        F.struct("week_start", "week_reflection", "month_start",
                                 "month_reflection").alias("head"))


def public_days(profiles: DataFrame, activities: DataFrame, logs: DataFrame,
                reflections: DataFrame, horizon: Horizon,
                part_size: int = PART_SIZE) -> DataFrame:
    """A document for every owner with a code and every day of the horizon.

    Pieces meet once per owner and month, where each text stands once; days are expanded after it.
    """
    people = _people(profiles)
    first, last = F.lit(horizon.start), F.lit(horizon.end)
    who, zero, at = F.struct("share_code", "owner_name").alias("who"), F.lit(0).alias("part_no"), F.col("period_date")
    months = D.months_touching(first, last)
    texts = reflections.join(people.select("owner_id"), "owner_id", "left_semi").select(
        "owner_id", zero, "period_type", "period_date", hide_blocks(F.col("content")).alias("text"))
    weekly = texts.where(F.col("period_type") == "weekly").select(
        "owner_id", zero, F.struct(at.alias("week_start"), "text").alias("weekly"),
        F.explode(D.months_touching(at, F.date_add(at, 6))).alias("month_start"))
    merged = _merged([
        people.select("owner_id", zero, who, F.explode(months).alias("month_start")),
        texts.where((F.col("period_type") == "monthly") & (at == D.month_start(at))).select(
            "owner_id", zero, at.alias("month_start"), F.col("text").alias("month_reflection")),
        weekly,
        _agenda_items(activities, logs, people, horizon, part_size).select(
            "owner_id", "part_no", "who", D.month_start(F.col("d")).alias("month_start"),
            F.struct("d", "item", "part_count").alias("today"))],
        ["owner_id", "month_start", "part_no"],
        {"who": F.max("who"), "items": F.collect_list("today"), "weeklies": F.collect_list("weekly"),
         "month_reflection": F.max("month_reflection")})
    d, month = F.col("d"), F.col("month_start")
    # Texts of months outside the horizon stand alone, without an owner's name.
    rows = merged.where(F.col("who").isNotNull()).withColumn("d", F.explode(
        D.days_between(F.greatest(month, first), F.least(D.month_end(month), last))))
    rows = rows.withColumn("own", F.filter("items", lambda x: x["d"] == F.col("d"))).where(
        (F.col("part_no") == 0) | (F.size("own") > 0))
    week = D.week_start(d)
    week_text = F.array_max(F.transform(
        F.filter("weeklies", lambda x: x["week_start"] == week), lambda x: x["text"]))
    items = F.transform(F.array_sort(F.transform("own", lambda x: x["item"])), lambda e: e["shown"])
    head = F.col("part_no") == 0
    return rows.select(
        "owner_id", F.col("who.share_code"), "d", "part_no",
        F.coalesce(F.array_max(F.transform("own", lambda x: x["part_count"])), F.lit(1)).alias("part_count"), F.struct(
            F.col("who.owner_name"), D.iso_date(d).alias("date"), items.alias("activities"),
            F.when(head, D.iso_date(week)).alias("week_start"), week_text.alias("week_reflection"),
            F.when(head, D.iso_date(month)).alias("month_start"), "month_reflection").alias("document"))


def past_reflections(profiles: DataFrame, reflections: DataFrame, horizon: Horizon,
                     as_of: dt.date) -> DataFrame:
    """What an opened day shows below its list: the reflections on its week
    and month, unless those are the current ones, which are shown elsewhere."""
    d, head, now = F.col("d"), "head", F.lit(as_of)
    return _day_heads(_people(profiles), reflections, horizon).select(
        "owner_id", "d",
        F.when(D.week_start(d) != D.week_start(now), F.col(f"{head}.week_reflection"))
        .alias("week_reflection"),
        F.when(D.month_start(d) != D.month_start(now), F.col(f"{head}.month_reflection"))
        .alias("month_reflection"))


def _goal_items(goals: DataFrame, activities: DataFrame, logs: DataFrame,
                people: DataFrame, as_of: dt.date, part_size: int) -> DataFrame:
    numbered = _numbered_goals(goals, part_size).join(
        people.select("owner_id", F.struct("share_code", "owner_name").alias("who")), "owner_id")
    shown = F.struct("title", F.col("period_type").alias("period"), "metric",
                     F.col("target").cast("double").alias("target"), "actual")
    return G.goals_at(numbered, activities, logs, as_of).select(
        "owner_id", "part_no", "part_count", "who",
        F.struct("created_at", "goal_id", shown.alias("shown")).alias("goal"))


def public_progress(profiles: DataFrame, activities: DataFrame, logs: DataFrame,
                    goals: DataFrame, reflections: DataFrame, as_of: dt.date,
                    part_size: int = PART_SIZE) -> DataFrame:
    """A document for every owner with a code, as seen on day ``as_of``."""
    people = _people(profiles)
    today = Horizon(as_of, as_of)
    week, month = today.widened_to_weeks(), today.widened_to_months()
    wide = Horizon(min(week.start, month.start), max(week.end, month.end))
    zero = F.lit(0).alias("part_no")

    texts = reflections.where(
        F.col("period_date") == D.period_start(F.col("period_type"), F.lit(as_of))).select(
        "owner_id", "period_type", hide_blocks(F.col("content")).alias("_text"))
    pieces = [
        people.select("owner_id", zero, F.struct("share_code", "owner_name").alias("who")),
        _agenda_items(activities, logs, people, today, part_size)
        .select("owner_id", "part_no", "part_count", "who", F.col("item").alias("today")),
        # The days serve the calendar and, added up, the week and the month.
        adherence.calendar_days(people, activities, logs, wide)
        .select("owner_id", zero, "d", "planned", "done"),
        _goal_items(goals, activities, logs, people, as_of, part_size),
        texts.join(people.select("owner_id"), "owner_id", "left_semi")
        .select("owner_id", zero, *[
            F.when(F.col("period_type") == p, F.col("_text")).alias(f"{p}_text")
            for p in ("daily", "weekly", "monthly")]),
    ]
    day = F.col("d")

    def total(span: Horizon) -> Column:
        inside = day.between(span.start, span.end)
        return F.struct(*[F.sum(F.when(inside, F.col(c))).alias(c) for c in ("done", "planned")])

    cell = F.struct(D.iso_date(day).alias("d"), "planned", "done")
    merged = _merged(pieces, ["owner_id", "part_no"], {
        # The longest list has items in every part, so each part knows its length.
        "who": F.max("who"), "part_count": F.coalesce(F.max("part_count"), F.lit(1)),
        "today": _in_order(F.col("today")),
        "week": total(week), "month": total(month),
        "calendar": _in_order(F.when(day.between(month.start, month.end),
                                     F.struct(day, cell.alias("shown")))),
        "goals": _in_order(F.col("goal")),
        "daily": F.max("daily_text"), "weekly": F.max("weekly_text"),
        "monthly": F.max("monthly_text")})
    return merged.select("owner_id", F.col("who.share_code"), "part_no", "part_count", F.struct(
        F.col("who.owner_name"), "today", "week", "month", "calendar", "goals",
        F.struct("daily", "weekly", "monthly").alias("reflections")).alias("document"))
