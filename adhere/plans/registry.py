"""The named queries over a data folder, each a (spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions import dates as D
from ..functions import names as N
from ..functions.private import hide_blocks, hide_lines
from ..model import TABLES, Horizon
from ..operators import (adherence, goals, occurrences, onboarding, quality, removals,
                         sharing, template_edits, upserts)
from ..session import work_path
from ..sources import readers, sinks
from ..sources.driver_tables import DriverTables
from ..sources.sinks import as_json
from ..streaming import log_feed
from . import by_day, publish, reports, sql_functions

# The events are of January 2024; reports cover that month, seen from its middle.
HORIZON = Horizon(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
AS_OF = dt.date(2024, 1, 17)
# Edits from this moment on are the feed; those before it made the current tables.
FEED_START = "2024-01-16 00:00:00"

Query = Callable[[DriverTables], DataFrame]
_queries: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _queries[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(DriverTables(spark, folder))

    return {name: bound(fn) for name, fn in _queries.items()}


# ---- adherence

@_query
def week_adherence(t):
    return adherence.week_adherence(t.profiles, t.activities, t.logs, HORIZON)


@_query
def month_adherence(t):
    return adherence.month_adherence(t.profiles, t.activities, t.logs, HORIZON)


@_query
def calendar_days(t):
    return adherence.calendar_days(t.profiles, t.activities, t.logs, HORIZON)


@_query
def month_grid(t):
    return adherence.month_grid(calendar_days(t))


@_query
def day_tally(t):
    return adherence.day_tally(t.profiles, t.activities, t.logs, HORIZON, AS_OF)


@_query
def category_minutes(t):
    return adherence.category_minutes(t.activities, t.logs, HORIZON) \
        .withColumn("label", C.duration_label(F.col("minutes"))) \
        .orderBy("owner_id", "d", F.desc("minutes"), "category")


@_query
def period_minutes(t):
    return adherence.period_minutes(t.logs, HORIZON)


# ---- occurrences

@_query
def planned_occurrences(t):
    return occurrences.occurrences(t.activities, HORIZON).select(
        "owner_id", "d", "activity_id", "title", "day_type", "sort_order")


@_query
def agenda(t):
    return occurrences.agenda(t.activities, t.logs, HORIZON).select(
        "owner_id", "d", "activity_id", "title", "category", "sort_order", "one_off", "logged",
        "completed", "planned_start_min", "planned_end_min", "actual_start_min",
        "actual_end_min", "note")


# ---- pages

@_query
def week_report(t):
    return reports.week_report(t.profiles, t.activities, t.logs, t.reflections, HORIZON, AS_OF)


@_query
def month_report(t):
    return reports.month_report(t.profiles, t.activities, t.logs, t.reflections, HORIZON, AS_OF)


@_query
def day_detail(t):
    return reports.day_detail(t.activities, t.logs, t.goals, HORIZON, AS_OF)


@_query
def today_list(t):
    return reports.today_list(t.activities, t.logs, t.goals, AS_OF)


@_query
def time_labels(t):
    """Every date and clock label, for every edit."""
    d, start, end = F.col("log_date"), F.col("actual_start_min"), F.col("actual_end_min")
    as_of = F.lit(AS_OF)
    return t.edits.select(
        "seq", D.iso_date(d).alias("iso"), D.long_label(d).alias("long_label"),
        D.short_label(d).alias("short_label"), D.month_label(d).alias("month_label"),
        D.day_type(d).alias("day_type"), D.week_start(d).alias("week_start"),
        D.week_end(d).alias("week_end"), D.month_start(d).alias("month_start"),
        D.month_end(d).alias("month_end"), D.shift_weeks(d, -2).alias("two_weeks_before"),
        D.shift_months(d, 1).alias("next_month"),
        D.offset_label(D.weeks_from(as_of, d), "week").alias("week_caption"),
        C.hhmm_or_blank(start).alias("start_text"), C.hhmm_or_dash(end).alias("end_text"),
        C.parse_hhmm(C.hhmm(start)).alias("start_again"),
        C.duration_label(C.span_minutes(start, end)).alias("active"),
        (D.parse_iso(D.iso_date(d)) > as_of).alias("is_future"))


# ---- goals

@_query
def goal_progress(t):
    return goals.goal_progress(t.goals, t.activities, t.logs, HORIZON).select(
        "goal_id", "owner_id", "period_type", "period_start", "metric", "actual", "pct")


@_query
def goal_labels(t):
    progress = goals.goal_progress(t.goals, t.activities, t.logs, HORIZON)
    return goals.goal_labels(progress).select(
        "goal_id", "period_start", "title", "target_unit", "label")


@_query
def goals_report(t):
    return reports.goals_report(t.goals, t.activities, t.logs, AS_OF).select(
        "goal_id", "owner_id", "title", "period_start",
        D.period_end(F.col("period_type"), F.col("period_start")).alias("period_end"),
        "actual", "pct", "caption")


# ---- private text

@_query
def redacted_notes(t):
    return t.edits.select("seq", hide_blocks(F.col("note")).alias("note"))


@_query
def redacted_reflections(t):
    text = F.col("content")
    return t.reflection_edits.select("seq", hide_blocks(text).alias("without_blocks"),
                                     hide_lines(text).alias("without_lines"))


# ---- documents

@_query
def public_day(t):
    days = publish.public_days(t.profiles, t.activities, t.logs, t.reflections, HORIZON)
    return days.select("owner_id", "share_code", "d", "part_no", "part_count",
                       as_json("document").alias("document"))


@_query
def public_progress(t):
    docs = publish.public_progress(t.profiles, t.kept("activities"), t.kept("logs"), t.goals,
                                   t.reflections, AS_OF)
    return docs.select("owner_id", "share_code", "part_no", "part_count",
                       as_json("document").alias("document"))


@_query
def past_reflections(t):
    return publish.past_reflections(t.profiles, t.reflections, HORIZON, AS_OF)


# ---- sharing

@_query
def public_schedule(t):
    return sharing.public_schedule(t.profiles, t.activities) \
        .orderBy("share_code", "day_type", "sort_order")


@_query
def public_schedule_with_one_offs(t):
    return sharing.public_schedule(t.profiles, t.activities, recurring_only=False)


@_query
def schedules_by_code(t):
    """The schedules behind all codes that were typed anywhere in the feed."""
    found = sharing.of_codes(t.profiles, t.share_requests)
    return sharing.public_schedule(found, t.activities)


@_query
def schedules_from_code_table(t):
    """The same from schedules stored in the order of their codes, with a filter on the codes asked for."""
    path = f"{work_path(t.spark, 'by-code')}/schedules"
    schedules = sharing.public_schedule(t.profiles, t.activities)
    sinks.write_by_code(schedules, path)
    stored = t.spark.read.schema(schedules.schema).parquet(path)
    wanted = t.share_requests.select(N.clean_code(F.col("code")).alias("share_code"))
    return stored.join(wanted, "share_code", "left_semi")


@_query
def share_lists(t):
    return sharing.share_lists(t.profiles, t.shares)


@_query
def share_requests(t):
    return sharing.resolve_requests(t.share_requests, t.profiles).select(
        "seq", "owner_id", "viewer_id", "permission", "outcome")


@_query
def granted_shares(t):
    return sharing.granted_shares(sharing.resolve_requests(t.share_requests, t.profiles))


@_query
def visible_rows(t):
    tables = {"activities": t.activities, "logs": t.logs, "reflections": t.reflections,
              "goals": t.goals}
    return sharing.visible_counts(tables, t.shares, sharing.grants(t.profiles, t.shares))


def _visible(t, name: str, *columns: str) -> DataFrame:
    viewers = t.profiles.select(F.col("owner_id").alias("viewer_id"))
    granted = sharing.grants(t.profiles, t.shares)
    return sharing.visible_to(getattr(t, name), granted, viewers).select(
        "viewer_id", "owner_id", *columns)


@_query
def visible_activities(t):
    """Recurring and one-off entries by everybody who may read them."""
    return _visible(t, "activities", "activity_id", "title", "day_type", "entry_date")


@_query
def visible_logs(t):
    return _visible(t, "logs", "activity_id", "log_date", "completed", "note",
                    "actual_start_min", "actual_end_min")


@_query
def visible_reflections(t):
    return _visible(t, "reflections", "period_type", "period_date", "content")


@_query
def visible_goals(t):
    return _visible(t, "goals", "goal_id", "title", "period_type", "metric")


@_query
def editable_owners(t):
    return sharing.editable(sharing.grants(t.profiles, t.shares)) \
        .select("viewer_id", "owner_id")


@_query
def edit_permissions(t):
    """For every edit, whether its author may write logs, and shares."""
    granted = sharing.grants(t.profiles, t.shares)
    checked = sharing.with_permission(t.edit_authors, granted)
    own = sharing.with_permission(checked.withColumnRenamed("permitted", "may_write_logs"),
                                  granted, own_only=True)
    return own.withColumnRenamed("permitted", "may_write_shares")


@_query
def shared_templates(t):
    viewers = t.profiles.select(F.col("owner_id").alias("viewer_id"))
    granted = sharing.grants(t.profiles, t.shares)
    return sharing.shared_template(t.activities, granted, viewers).select(
        "viewer_id", "owner_id", "activity_id", "title", "day_type", "sort_order")


@_query
def readable_shares(t):
    viewers = t.profiles.select(F.col("owner_id").alias("viewer_id"))
    return sharing.shares_visible_to(t.shares, viewers) \
        .select("reader_id", "owner_id", "viewer_id", "permission")


# ---- edit feeds

def _log_rows(edits: DataFrame) -> DataFrame:
    return edits.select("owner_id", "activity_id", "log_date", "completed", "note",
                        "actual_start_min", "actual_end_min", "ts", "seq")


def _split(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits before the feed, and the feed."""
    start = F.lit(FEED_START).cast("timestamp_ntz")
    return edits.where(F.col("ts") < start), edits.where(F.col("ts") >= start)


@_query
def logs_upsert(t):
    before, feed = _split(_log_rows(t.edits))
    current = upserts.latest_per_key(before, upserts.LOG_KEY, ["ts", "seq"])
    return upserts.upsert(current, feed, upserts.LOG_KEY, ["ts", "seq"]).drop("ts")


@_query
def logs_patch_merge(t):
    return upserts.fold_log_patches(t.edits)


@_query
def logs_patched(t):
    """Patches of the feed over whole rows that were there before."""
    before, feed = _split(t.edits)
    current = upserts.latest_per_key(_log_rows(before), upserts.LOG_KEY, ["ts", "seq"])
    return upserts.patch_current_logs(current, feed)


@_query
def note_changes(t):
    before, feed = _split(t.edits)
    current = upserts.latest_per_key(_log_rows(before), upserts.LOG_KEY, ["ts", "seq"])
    return upserts.note_changes(current, feed)


@_query
def reflections_upsert(t):
    """Every second text was there before; the others are the feed."""
    feed = F.floor(F.col("seq") / 3) % 2 == 1
    before = upserts.latest_per_key(t.reflection_edits.where(~feed), upserts.REFLECTION_KEY, ["seq"])
    merged = upserts.upsert(before, t.reflection_edits.where(feed), upserts.REFLECTION_KEY, ["seq"])
    return merged.select(*upserts.REFLECTION_KEY, "content")


@_query
def shares_upsert(t):
    return upserts.upsert(
        t.shares.withColumns({"ts": F.lit(None).cast("timestamp_ntz"),
                              "seq": F.lit(None).cast("long")}),
        t.share_edits, upserts.SHARE_KEY, ["ts", "seq"], removed="removed") \
        .select("owner_id", "viewer_id", "permission")


@_query
def clean_activities(t):
    return template_edits.clean_activity_forms(t.activity_forms).drop("created_at")


@_query
def clean_goals(t):
    return template_edits.clean_goal_forms(t.goal_forms).withColumn(
        "target", F.col("target").cast("double"))


@_query
def insert_positions(t):
    cleaned = template_edits.clean_activity_forms(t.activity_forms)
    return template_edits.place_one_offs(cleaned, t.activities) \
        .select("seq", "owner_id", "entry_date", "title", "sort_order")


@_query
def template_positions(t):
    """The same forms taken as recurring entries of their day's type."""
    cleaned = template_edits.clean_activity_forms(t.activity_forms) \
        .withColumn("day_type", D.day_type(F.col("entry_date")))
    return template_edits.place_in_template(cleaned, t.activities) \
        .select("seq", "owner_id", "day_type", "sort_order")


@_query
def changed_rows(t):
    return template_edits.activity_changes(t.activities, t.activity_patches)


@_query
def patched_activities(t):
    fields = list(template_edits.ACTIVITY_PATCH_FIELDS)
    return upserts.apply_changes(t.activities, changed_rows(t), ["activity_id"], fields) \
        .select("activity_id", "owner_id", "sort_order", *fields)


@_query
def tagged_activities(t):
    """Goal tags alone: no other field of an activity may change."""
    tags = t.activity_patches.where("sets_goal AND NOT sets_title")
    return template_edits.activity_changes(t.activities, tags)


@_query
def reorder_changes(t):
    return template_edits.reorder_changes(t.activities, t.moves)


@_query
def seed_defaults(t):
    return template_edits.seed_defaults(t.profiles, t.activities)


# ---- removals

@_query
def cascade_delete(t):
    out = removals.delete_activities(t.activities, t.logs, t.dropped_activities)

    def keys(name: str, fate: str) -> DataFrame:
        return out[name].select(*upserts.LOG_KEY, F.lit(fate).alias("fate"))

    return keys("logs", "kept").unionByName(keys("removed_logs", "removed"))


@_query
def goal_unlink(t):
    out = removals.delete_goals(t.goals, t.activities, t.dropped_goals)
    return out["activities"].select("activity_id", "owner_id", "title", "goal_id")


@_query
def owner_erasure(t):
    left = removals.erase_owners(
        {"profiles": t.profiles, "activities": t.activities, "logs": t.logs,
         "reflections": t.reflections, "shares": t.shares, "goals": t.goals},
        t.closed_accounts)
    return reduce(DataFrame.unionByName, [_row_keys(df, name) for name, df in left.items()])


@_query
def removals_by_reference(t):
    """Closed accounts, dropped activities and dropped goals removed at once, with all that refers to them."""
    tables = {name: t.kept(name) if name in ("activities", "logs") else getattr(t, name) for name in TABLES}
    left, record = removals.remove(tables, {
        "profiles": t.closed_accounts, "activities": t.dropped_activities, "goals": t.dropped_goals})
    kept = reduce(DataFrame.unionByName, [_row_keys(df, name, F.lit("kept").alias("fate")) for name, df in left.items()])
    unlinked = record.where("fate = 'unlinked'").select("table_name", "row_key", F.lit("unlinked").alias("fate"))
    return kept.unionByName(unlinked).unionByName(record.where("fate = 'removed'").drop("cause"))


def _row_keys(df: DataFrame, name: str, *more: Column) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), F.concat_ws(
        "|", *[F.col(k).cast("string") for k in TABLES[name].key]).alias("row_key"), *more)


# ---- quality and onboarding

@_query
def constraint_violations(t):
    checked = quality.with_violations(t.untidy_goals, "goals")
    return checked.select("goal_id", F.concat_ws("; ", "violations").alias("violations"))


@_query
def table_violations(t):
    """Rows of all six tables that break a rule."""
    return reduce(DataFrame.unionByName, [
        _row_keys(quality.quarantined_rows(quality.with_violations(t.untidy(name), name)), name,
                  F.concat_ws("; ", "violations").alias("violations")) for name in TABLES])


@_query
def quarantined_goals(t):
    checked = quality.with_violations(t.untidy_goals, "goals")
    return quality.quarantined_rows(checked).select(
        "goal_id", F.size("violations").cast("long").alias("rules_broken"))


@_query
def valid_goals(t):
    return quality.valid_rows(quality.with_violations(t.untidy_goals, "goals")).select(
        "goal_id", "owner_id", "title", "period_type", "metric")


@_query
def orphans(t):
    """What would point to nothing if only the closed profiles were removed."""
    profiles = t.profiles.join(t.closed_accounts, "owner_id", "left_anti")
    goals_left = t.goals.join(t.dropped_goals, "goal_id", "left_anti")
    return quality.orphans({
        "profiles": profiles, "activities": t.activities, "logs": t.logs,
        "reflections": t.reflections, "shares": t.shares, "goals": goals_left})


@_query
def duplicate_keys(t):
    """The feeds taken for tables: every key written more than once."""
    return quality.all_duplicate_keys({
        "profiles": t.profiles, "activities": t.edits, "logs": t.edits,
        "reflections": t.reflection_edits, "shares": t.share_edits,
        "goals": t.goal_forms.select((F.col("owner_id") * 2).alias("goal_id"))})


@_query
def signup_profiles(t):
    made = onboarding.profiles_from_signups(t.signups)
    return made.withColumn("login", N.email_for(F.col("username"), "example.org"))


@_query
def profile_backfill(t):
    bare = t.profiles.withColumn(
        "username", F.when(F.col("owner_id") % 3 != 0, F.col("username")))
    return onboarding.backfill_names(bare).select(
        "owner_id", "username", "display_name",
        N.person_label(F.col("display_name"), F.col("username")).alias("label"))


@_query
def share_codes(t):
    fresh = t.profiles.withColumn("share_code", F.lit(None).cast("string"))
    return onboarding.assign_share_codes(fresh)


# ---- every day as "today"

@_query
def goals_by_day(t):
    return by_day.goals_by_day(t.goals, t.activities, t.logs, HORIZON).select(
        "goal_id", "owner_id", "d", "period_start", "period_end", "actual", "so_far", "pct", "pct_so_far",
        "caption")


@_query
def totals_to_date(t):
    return by_day.totals_to_date(t.profiles, t.activities, t.logs, HORIZON)


@_query
def progress_by_day(t):
    docs = by_day.progress_by_day(t.profiles, t.kept("activities"), t.kept("logs"), t.goals, t.reflections, HORIZON)
    return docs.withColumn("document", as_json("document"))


# ---- functions called from SQL

def _with_functions(t: DriverTables) -> SparkSession:
    """The session with the SQL functions over these tables; activities and logs are derived once."""
    sql_functions.register(t.spark, {name: t.kept(name) if name in ("activities", "logs") else getattr(t, name)
                                     for name in sql_functions.VIEWS})
    return t.spark


@_query
def sql_strip_private(t):
    """Notes and reflections through the scalar function."""
    spark = _with_functions(t)
    return spark.sql("""
        SELECT 'note' AS kind, seq, strip_private(note) AS shown FROM {edits}
        UNION ALL SELECT 'reflection', seq, strip_private(content) FROM {reflections}""",
        edits=t.edits, reflections=t.reflection_edits)


@_query
def sql_access(t):
    """For every edit, whether its author may read and write its owner's rows."""
    spark = _with_functions(t)
    return spark.sql("""
        SELECT seq, owner_id, author_id, can_view(author_id, owner_id) AS may_view,
               can_edit(author_id, owner_id) AS may_edit FROM {edits}""", edits=t.edit_authors)


@_query
def sql_editable_logs(t):
    """Logs that the writer of each log's edit may still change: a filter by function."""
    spark = _with_functions(t)
    return spark.sql("""
        SELECT e.seq, l.activity_id, l.log_date FROM {edits} e JOIN shared_logs l
          ON l.owner_id = e.owner_id AND l.activity_id = e.activity_id AND l.log_date = e.log_date
        WHERE can_edit(e.author_id, l.owner_id)""", edits=t.edits.withColumn(
        "author_id", F.col("owner_id") + F.col("seq") % 6))


@_query
def sql_public_schedule(t):
    """The schedule behind every typed code."""
    spark = _with_functions(t)
    return spark.sql("""
        SELECT r.seq, s.* FROM {asked} r, LATERAL get_public_schedule(r.code) s""", asked=t.share_requests)


@_query
def sql_public_day(t):
    """The day page behind every typed code, for the date it was typed.

    A list is made once per code and date and carries its calls, in packs of at most a million numbers. The days of a
    week or a month show the same text, so it is asked for once, with their first day, and meets the lists by code:
    beside a list it would travel once per date. What a call does not select is not worked out.
    """
    spark = _with_functions(t)
    return spark.sql("""
        WITH days AS (
            SELECT r.code, r.calls, p.owner_name, p.date, p.activities, p.week_start, p.month_start
            FROM (SELECT code, d, collect_list(struct(seq)) AS calls FROM {asked} GROUP BY code, d, seq DIV 1000000) r,
                 LATERAL get_public_day(r.code, r.d) p),
        weeks AS (
            SELECT r.code, collect_list(struct(p.owner_name, p.week_start, p.week_reflection)) AS texts
            FROM (SELECT DISTINCT code, trunc(d, 'week') AS d FROM {asked}) r, LATERAL get_public_day(r.code, r.d) p
            WHERE p.week_reflection IS NOT NULL GROUP BY r.code),
        months AS (
            SELECT r.code, collect_list(struct(p.owner_name, p.month_start, p.month_reflection)) AS texts
            FROM (SELECT DISTINCT code, trunc(d, 'month') AS d FROM {asked}) r, LATERAL get_public_day(r.code, r.d) p
            WHERE p.month_reflection IS NOT NULL GROUP BY r.code),
        pages AS (
            SELECT d.calls, to_json(struct(
                d.owner_name, d.date, d.activities, d.week_start,
                get(filter(w.texts, x -> x.owner_name <=> d.owner_name AND x.week_start = d.week_start), 0).week_reflection,
                d.month_start,
                get(filter(m.texts, x -> x.owner_name <=> d.owner_name AND x.month_start = d.month_start), 0).month_reflection
                ), map('ignoreNullFields', 'false')) AS document
            FROM days d LEFT JOIN weeks w ON w.code = d.code LEFT JOIN months m ON m.code = d.code)
        SELECT c.seq, document FROM pages LATERAL VIEW inline(calls) c AS seq""",
        asked=t.share_requests.select("seq", "code", F.to_date("ts").alias("d")))


@_query
def sql_public_progress(t):
    """The progress page of every owner."""
    spark = _with_functions(t)
    return spark.sql(f"""
        SELECT o.owner_id, o.share_code, to_json(struct(p.*), map('ignoreNullFields', 'false')) AS document
        FROM shared_profiles o, LATERAL get_public_progress(o.share_code, DATE '{AS_OF}') p""")


# ---- tables written and read again

@_query
def logs_round_trip(t):
    """Logs written by month and read for the horizon."""
    path = f"{work_path(t.spark, 'logs')}/logs"
    sinks.write_logs(t.logs, path)
    return readers.read_logs(t.spark, path, HORIZON).select(
        "owner_id", "activity_id", "log_date", "completed", "note", "actual_start_min",
        "actual_end_min")


@_query
def tables_round_trip(t):
    """All six tables written and read; activities from a time before colors and goals."""
    where = work_path(t.spark, "tables")
    read = []
    for name in TABLES:
        df = getattr(t, name)
        if name == "activities":
            df = df.drop("color", "goal_id")
        sinks.write_rows(df, f"{where}/{name}")
        back = readers.read_table(t.spark, name, f"{where}/{name}")
        lost = F.col("goal_id").isNull() if name == "activities" else F.lit(False)
        read.append(_row_keys(back, name, lost.alias("goal_lost")))
    return reduce(DataFrame.unionByName, read)


@_query
def logs_upsert_by_month(t):
    """The feed into a table on disk: only the months it touches are read and written."""
    before, feed = _split(_log_rows(t.edits))
    path = f"{work_path(t.spark, 'logs')}/logs"
    sinks.write_months(upserts.latest_per_key(before, upserts.LOG_KEY, ["ts", "seq"]), path)
    sinks.upsert_months(feed, path, ["ts", "seq"])
    return sinks.read_months(t.spark, path, feed.schema).drop("ts")


# ---- streams, run until their input is used up

@_query
def stream_logs(t):
    where = work_path(t.spark, "stream-logs")
    log_feed.follow_logs(t.edit_stream(), f"{where}/deltas", f"{where}/checkpoint")
    return log_feed.current_logs(log_feed.read_deltas(t.spark, f"{where}/deltas"))


@_query
def stream_day_tally(t):
    where = work_path(t.spark, "stream-tally")
    log_feed.follow_tallies(t.edit_stream(), t.activities, f"{where}/deltas",
                            f"{where}/tallies", f"{where}/checkpoint")
    return log_feed.current_tallies(t.spark, f"{where}/tallies")


@_query
def stream_tally_changes(t):
    """The tallies again, from signed changes, over several batches and their folds."""
    where = work_path(t.spark, "stream-changes")
    for _ in log_feed.arrivals(t.edits, f"{where}/in", 5):
        log_feed.follow_tally_changes(log_feed.arrived(t.edits, f"{where}/in"), t.kept("activities"), where,
                                      f"{where}/checkpoint", every=2)
    return log_feed.tallies_from_changes(t.spark, where, t.kept("activities"), every=2)


@_query
def stream_log_state(t):
    """Logs from the stream's own state; the stream stops and starts again in the middle of its input."""
    where = work_path(t.spark, "stream-state")
    for _ in log_feed.arrivals(t.edits, f"{where}/in", 2):
        log_feed.follow_log_state(log_feed.arrived(t.edits, f"{where}/in"), f"{where}/rows", f"{where}/checkpoint")
    return log_feed.logs_of_state(t.spark, f"{where}/rows")


@_query
def stream_windowed_weeks(t):
    """Weekly edits from windows under a watermark, with what came too late for them; every part of the
    feed covers the whole month, so most of the later parts' edits are late."""
    where = work_path(t.spark, "stream-windows")
    for _ in log_feed.arrivals(t.edits, f"{where}/in", 3):
        log_feed.follow_windowed_weeks(log_feed.arrived(t.edits, f"{where}/in"), f"{where}/out",
                                       f"{where}/checkpoint")
    return log_feed.windowed_weeks(t.spark, f"{where}/out").select("owner_id", "week_start", "edits")


@_query
def stream_week_edits(t):
    where = work_path(t.spark, "stream-weeks")
    log_feed.follow_weekly_counts(t.edit_stream(), f"{where}/counts", f"{where}/checkpoint")
    return log_feed.current_weekly_counts(t.spark, f"{where}/counts")
