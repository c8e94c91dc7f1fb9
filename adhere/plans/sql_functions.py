"""The functions people call by name: scalar and table functions defined in SQL over views.

``register`` makes them for a session. Bodies are plain SQL, so the optimizer sees
through them: a call with a code reads that owner's rows, a lateral call for a table of codes is
joined, and ``can_view`` in a filter is an existence join. No Python runs in any of them.

| function | result |
| --- | --- |
| ``strip_private(t)`` | text without private blocks, null when nothing is left |
| ``clean_code(code)`` | a share code as stored |
| ``clock(m)`` | minutes of the day as ``HH:MM`` |
| ``percent_done(done, planned)`` | rounded percentage, 0 without a plan |
| ``can_view(viewer, owner)``, ``can_edit(viewer, owner)`` | may read, may write |
| ``get_public_schedule(code)`` | template rows under the owner's name |
| ``get_public_day(code, d)`` | one row: the owner's day with its list and reflections |
| ``get_public_progress(code, today)`` | one row: today, week, month, calendar, goals, reflections |

Codes that belong to nobody give no row. Viewers and "today" are arguments; nothing here asks who is
signed in or what time it is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import PAGE_BLANKS

VIEWS = ("profiles", "activities", "logs", "reflections", "shares", "goals")
#: Views carry this prefix, so that no view of the session is replaced.
PREFIX = "shared_"


def _strip(text: str) -> str:
    # The patterns that define what counts as private (see functions/private.py).
    return (f"nullif(trim(BOTH ' \\t\\n' FROM regexp_replace(regexp_replace({text}, "
            r"R'(?s)/\*.*?(?:\*/|\z)', ''), R'(?s)/\*.*', '')), '')")


def _code(text: str) -> str:
    blanks = "".join(f"\\u{ord(c):04x}" for c in PAGE_BLANKS)
    return f"upper(trim(BOTH '{blanks}' FROM {text}))"


def _clock(minutes: str) -> str:
    return (f"concat(lpad(CAST(floor({minutes} / 60) AS STRING), 2, '0'), ':', "
            f"lpad(CAST({minutes} % 60 AS STRING), 2, '0'))")


def _day_type(d: str) -> str:
    return f"CASE WHEN weekday({d}) >= 5 THEN 'weekend' ELSE 'weekday' END"


def _in_order(items: str) -> str:
    """Structs sorted by their leading fields, of which ``shown`` is kept; nulls are left out."""
    return f"transform(array_sort(collect_list({items})), x -> x.shown)"


_ITEM = ("STRUCT<title: STRING, category: STRING, planned_start: STRING, planned_end: STRING, "
         "completed: BOOLEAN, actual_start: STRING, actual_end: STRING, note: STRING>")
_SHOWN = f"""CASE WHEN a.activity_id IS NOT NULL THEN struct(
    a.sort_order, a.created_at, a.activity_id, struct(
      a.title AS title, a.category AS category, {_clock('a.planned_start_min')} AS planned_start,
      {_clock('a.planned_end_min')} AS planned_end, coalesce(l.completed, false) AS completed,
      {_clock('l.actual_start_min')} AS actual_start, {_clock('l.actual_end_min')} AS actual_end,
      {_strip('l.note')} AS note) AS shown) END"""


def _agenda(owners: str) -> str:
    """Rows of ``owners`` (owner_id, day) with their plan of the day as ``a`` and its logs as ``l``."""
    return f"""{owners} o
    LEFT JOIN {{p}}activities a ON a.owner_id = o.owner_id
      AND (a.entry_date = o.day OR (a.entry_date IS NULL AND a.day_type = {_day_type('o.day')}))
    LEFT JOIN {{p}}logs l ON l.owner_id = o.owner_id AND l.activity_id = a.activity_id AND l.log_date = o.day"""


def _owner_of(function: str, day: str) -> str:
    """The owner of a code beside the asked day. Both arguments come as one row that is joined by
    the code; a day beside every profile would be a cross join for a table of calls."""
    return (f"(SELECT p.owner_id, coalesce(p.display_name, p.username) AS owner_name, q.day "
            f"FROM (SELECT {_code(f'{function}.code')} AS code, {function}.{day} AS day) q "
            f"JOIN {{p}}profiles p ON p.share_code = q.code)")


_DAY_OWNER = _owner_of("get_public_day", "d")
_TODAY_OWNER = _owner_of("get_public_progress", "today")
_WEEK, _MONTH = "trunc(o.day, 'week')", "trunc(o.day, 'month')"
_WEEK_END, _MONTH_END = f"date_add({_WEEK}, 6)", "last_day(o.day)"


def _period(edge: str) -> str:
    week, month = (_WEEK, _MONTH) if edge == "start" else (_WEEK_END, _MONTH_END)
    return f"CASE g.period_type WHEN 'weekly' THEN {week} ELSE {month} END"


def _texts(period_type: str, start: str) -> str:
    """A left join of the shown texts of one kind of reflection, as ``period_type``. They join finished lists: beside
    the rows of a list, a text would be shuffled and sorted once for each of its items. The kind is part of the join's
    key, though it is one value: so the key is that of the table, whose rows stay where its making has dealt them, and
    a call that does not select the text joins nothing. Days that are null have no text either way."""
    return f"""LEFT JOIN (SELECT owner_id, period_type, period_date, {_strip('content')} AS text
          FROM {{p}}reflections WHERE period_type = '{period_type}') {period_type}
          ON {period_type}.owner_id = o.owner_id
          AND {period_type}.period_type = CASE WHEN o.day IS NOT NULL THEN '{period_type}' END
          AND {period_type}.period_date = {start}"""


_FUNCTIONS = {
    "strip_private(t STRING)": ("STRING", _strip("t")),
    "clean_code(code STRING)": ("STRING", _code("code")),
    "clock(m INT)": ("STRING", _clock("m")),
    "percent_done(done BIGINT, planned BIGINT)": (
        "INT", "CASE WHEN planned = 0 THEN 0 ELSE CAST(floor("
               "CAST(done AS DOUBLE) / CAST(planned AS DOUBLE) * 100 + 0.5) AS INT) END"),
    "can_view(viewer BIGINT, owner BIGINT)": ("BOOLEAN", """coalesce(viewer = owner, false) OR EXISTS (
        SELECT 1 FROM {p}shares s WHERE s.owner_id = can_view.owner AND s.viewer_id = can_view.viewer)"""),
    "can_edit(viewer BIGINT, owner BIGINT)": ("BOOLEAN", """coalesce(viewer = owner, false) OR EXISTS (
        SELECT 1 FROM {p}shares s WHERE s.owner_id = can_edit.owner AND s.viewer_id = can_edit.viewer
          AND s.permission = 'edit')"""),
    "get_public_schedule(code STRING)": (
        "TABLE(owner_name STRING, title STRING, day_type STRING, planned_start_min INT, "
        "planned_end_min INT, category STRING, sort_order INT)", f"""
        SELECT coalesce(p.display_name, p.username), a.title, a.day_type, a.planned_start_min,
               a.planned_end_min, a.category, a.sort_order
        FROM {{p}}profiles p JOIN {{p}}activities a ON a.owner_id = p.owner_id
        WHERE p.share_code = {_code('get_public_schedule.code')} AND a.entry_date IS NULL"""),
    "get_public_day(code STRING, d DATE)": (
        f"TABLE(owner_name STRING, date STRING, activities ARRAY<{_ITEM}>, week_start STRING, "
        "week_reflection STRING, month_start STRING, month_reflection STRING)", f"""
        SELECT o.owner_name, date_format(o.day, 'yyyy-MM-dd'), o.items,
               date_format({_WEEK}, 'yyyy-MM-dd'), weekly.text, date_format({_MONTH}, 'yyyy-MM-dd'), monthly.text
        FROM (SELECT o.owner_id, o.owner_name, o.day, {_in_order(_SHOWN)} AS items
              FROM {_agenda(_DAY_OWNER)} GROUP BY o.owner_id, o.owner_name, o.day) o
        {_texts('weekly', _WEEK)}
        {_texts('monthly', _MONTH)}"""),
    "get_public_progress(code STRING, today DATE)": (
        f"TABLE(owner_name STRING, today ARRAY<{_ITEM}>, week STRUCT<done: BIGINT, planned: BIGINT>, "
        "month STRUCT<done: BIGINT, planned: BIGINT>, "
        "calendar ARRAY<STRUCT<d: STRING, planned: BIGINT, done: BIGINT>>, "
        "goals ARRAY<STRUCT<title: STRING, period: STRING, metric: STRING, target: DOUBLE, actual: BIGINT>>, "
        "reflections STRUCT<daily: STRING, weekly: STRING, monthly: STRING>)", f"""
        SELECT o.owner_name, t.items, c.week, c.month, c.calendar, g.goals,
               struct(r.daily AS daily, r.weekly AS weekly, r.monthly AS monthly)
        FROM {_TODAY_OWNER} o
        JOIN (SELECT o.owner_id, o.day, {_in_order(_SHOWN)} AS items
              FROM {_agenda(_TODAY_OWNER)} GROUP BY o.owner_id, o.day) t
          ON t.owner_id = o.owner_id AND t.day = o.day
        JOIN (SELECT o.owner_id, o.day,
                struct(sum(CASE WHEN o.d BETWEEN {_WEEK} AND {_WEEK_END} THEN o.done END) AS done,
                       sum(CASE WHEN o.d BETWEEN {_WEEK} AND {_WEEK_END} THEN o.planned END) AS planned) AS week,
                struct(sum(CASE WHEN o.d BETWEEN {_MONTH} AND {_MONTH_END} THEN o.done END) AS done,
                       sum(CASE WHEN o.d BETWEEN {_MONTH} AND {_MONTH_END} THEN o.planned END) AS planned) AS month,
                {_in_order(f"CASE WHEN o.d BETWEEN {_MONTH} AND {_MONTH_END} THEN struct(o.d, struct("
                           "date_format(o.d, 'yyyy-MM-dd') AS d, o.planned AS planned, o.done AS done) AS shown) END")}
                  AS calendar
              FROM (SELECT x.owner_id, x.day, x.d, coalesce(f.n, 0) AS done,
                           coalesce(q.n, 0) + coalesce(e.n, 0) AS planned
                    FROM (SELECT o.owner_id, o.day, explode(sequence(
                            least({_WEEK}, {_MONTH}), greatest({_WEEK_END}, {_MONTH_END}))) AS d
                          FROM {_TODAY_OWNER} o) x
                    LEFT JOIN (SELECT owner_id, day_type, count(*) AS n FROM {{p}}activities
                               WHERE entry_date IS NULL GROUP BY owner_id, day_type) q
                      ON q.owner_id = x.owner_id AND q.day_type = {_day_type('x.d')}
                    LEFT JOIN (SELECT owner_id, entry_date, count(*) AS n FROM {{p}}activities
                               WHERE entry_date IS NOT NULL GROUP BY owner_id, entry_date) e
                      ON e.owner_id = x.owner_id AND e.entry_date = x.d
                    LEFT JOIN (SELECT owner_id, log_date, count(*) AS n FROM {{p}}logs
                               WHERE completed GROUP BY owner_id, log_date) f
                      ON f.owner_id = x.owner_id AND f.log_date = x.d) o
              GROUP BY o.owner_id, o.day) c
          ON c.owner_id = o.owner_id AND c.day = o.day
        JOIN (SELECT owner_id, day, {_in_order("CASE WHEN goal_id IS NOT NULL THEN struct(created_at, goal_id, struct("
              "title, period_type AS period, metric, CAST(target AS DOUBLE) AS target, actual) AS shown) END")} AS goals
              FROM (SELECT o.owner_id, o.day, g.goal_id, g.created_at, g.title, g.period_type, g.metric, g.target,
                           coalesce(sum(CASE WHEN g.metric = 'count' THEN CAST(l.completed AS BIGINT)
                             WHEN l.actual_end_min > l.actual_start_min
                             THEN l.actual_end_min - l.actual_start_min END), 0) AS actual
                    FROM {_TODAY_OWNER} o LEFT JOIN {{p}}goals g ON g.owner_id = o.owner_id
                    LEFT JOIN {{p}}activities a ON a.goal_id = g.goal_id
                    LEFT JOIN {{p}}logs l ON l.owner_id = g.owner_id AND l.activity_id = a.activity_id
                      AND l.log_date BETWEEN {_period('start')} AND {_period('end')}
                    GROUP BY ALL)
              GROUP BY owner_id, day) g
          ON g.owner_id = o.owner_id AND g.day = o.day
        JOIN (SELECT o.owner_id, o.day,
                     max(CASE WHEN r.period_type = 'daily' THEN {_strip('r.content')} END) AS daily,
                     max(CASE WHEN r.period_type = 'weekly' THEN {_strip('r.content')} END) AS weekly,
                     max(CASE WHEN r.period_type = 'monthly' THEN {_strip('r.content')} END) AS monthly
              FROM {_TODAY_OWNER} o LEFT JOIN {{p}}reflections r ON r.owner_id = o.owner_id
                AND r.period_date = CASE r.period_type WHEN 'weekly' THEN {_WEEK}
                                         WHEN 'monthly' THEN {_MONTH} ELSE o.day END
              GROUP BY o.owner_id, o.day) r
          ON r.owner_id = o.owner_id AND r.day = o.day"""),
}


def register(spark: SparkSession, tables: Mapping[str, DataFrame], prefix: str = PREFIX) -> None:
    """Makes views of the six tables (by their names of ``model``) and the functions over them.

    Registering again, with other tables, replaces both.
    """
    missing = set(VIEWS) - set(tables)
    if missing:
        raise ValueError(f"tables not given: {', '.join(sorted(missing))}")
    for name in VIEWS:
        tables[name].createOrReplaceTempView(f"{prefix}{name}")
    for signature, (returns, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} "
                  f"RETURN {body.replace('{p}', prefix)}")
