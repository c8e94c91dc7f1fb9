"""The tables: explicit schemas, keys, references and check rules.

Times of day are minutes since midnight. Dates are owner-local and typed
``DATE``; no operator reads the clock, so "today" is always an ``as_of``
argument.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import types as T

from . import fixed_values as V

_long, _int, _str = T.LongType(), T.IntegerType(), T.StringType()
_date, _bool, _ts = T.DateType(), T.BooleanType(), T.TimestampNTZType()
# As wide as a decimal gets; targets come without a bound on their digits.
TARGET_TYPE = T.DecimalType(38, 10)


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


PROFILES = _schema(("owner_id", _long), ("email", _str), ("username", _str),
                   ("share_code", _str), ("display_name", _str))
ACTIVITIES = _schema(("activity_id", _str), ("owner_id", _long), ("title", _str),
                     ("day_type", _str), ("planned_start_min", _int),
                     ("planned_end_min", _int), ("category", _str), ("sort_order", _int),
                     ("entry_date", _date), ("color", _str), ("goal_id", _long),
                     ("created_at", _ts))
LOGS = _schema(("owner_id", _long), ("activity_id", _str), ("log_date", _date),
               ("completed", _bool), ("note", _str), ("actual_start_min", _int),
               ("actual_end_min", _int), ("updated_at", _ts))
REFLECTIONS = _schema(("owner_id", _long), ("period_type", _str), ("period_date", _date),
                      ("content", _str), ("updated_at", _ts))
SHARES = _schema(("owner_id", _long), ("viewer_id", _long), ("permission", _str),
                 ("created_at", _ts))
GOALS = _schema(("goal_id", _long), ("owner_id", _long), ("title", _str),
                ("period_type", _str), ("metric", _str), ("target", TARGET_TYPE),
                ("created_at", _ts))


@dataclass(frozen=True)
class TableRules:
    """Everything the data-quality jobs need to know about one table."""

    schema: T.StructType
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    # column(s) here -> (table, column(s) there)
    references: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    # references that become null when their row is deleted; the others delete the row here as well
    set_null: tuple[tuple[str, ...], ...] = ()


_OWNER = (("owner_id",), "profiles", ("owner_id",))

TABLES: dict[str, TableRules] = {
    "profiles": TableRules(
        PROFILES, ("owner_id",), (("email",), ("username",), ("share_code",)), ("email",)),
    "activities": TableRules(
        ACTIVITIES, ("activity_id",), (),
        ("owner_id", "title", "day_type", "category", "sort_order"),
        {"day_type": V.DAY_TYPES},
        (_OWNER, (("goal_id",), "goals", ("goal_id",))), (("goal_id",),)),
    "logs": TableRules(
        LOGS, ("owner_id", "activity_id", "log_date"), (),
        ("owner_id", "activity_id", "log_date", "completed"), {},
        (_OWNER, (("activity_id",), "activities", ("activity_id",)))),
    "reflections": TableRules(
        REFLECTIONS, ("owner_id", "period_type", "period_date"), (),
        ("owner_id", "period_type", "period_date"), {"period_type": V.PERIOD_TYPES},
        (_OWNER,)),
    "shares": TableRules(
        SHARES, ("owner_id", "viewer_id"), (), ("owner_id", "viewer_id", "permission"),
        {"permission": V.PERMISSIONS},
        (_OWNER, (("viewer_id",), "profiles", ("owner_id",)))),
    "goals": TableRules(
        GOALS, ("goal_id",), (), ("owner_id", "title", "period_type", "metric", "target"),
        {"period_type": V.GOAL_PERIODS, "metric": V.GOAL_METRICS}, (_OWNER,)),
}


@dataclass(frozen=True)
class Horizon:
    """An inclusive range of days that a report covers."""

    start: dt.date
    end: dt.date

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError("horizon ends before it starts")

    def widened_to_weeks(self) -> "Horizon":
        return Horizon(self.start - dt.timedelta(days=self.start.weekday()),
                       self.end + dt.timedelta(days=6 - self.end.weekday()))

    def widened_to_months(self) -> "Horizon":
        following = (self.end.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        return Horizon(self.start.replace(day=1), following - dt.timedelta(days=1))
