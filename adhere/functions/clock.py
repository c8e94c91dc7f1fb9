"""Times of day as minutes since midnight, and spans between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import MISSING_TIME


def valid_span(start: Column, end: Column) -> Column:
    """Both ends set and in order. A span over midnight is not valid."""
    return start.isNotNull() & end.isNotNull() & (end > start)


def span_minutes(start: Column, end: Column) -> Column:
    """Length of a valid span, else 0."""
    return F.when(valid_span(start, end), end - start).otherwise(0).cast("long")


def hhmm(minutes: Column) -> Column:
    """``HH:MM``; null stays null."""
    return F.concat(
        F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((minutes % 60).cast("string"), 2, "0"))


def hhmm_or_blank(minutes: Column) -> Column:
    return F.coalesce(hhmm(minutes), F.lit(""))


def hhmm_or_dash(minutes: Column) -> Column:
    return F.coalesce(hhmm(minutes), F.lit(MISSING_TIME))


def parse_hhmm(text: Column) -> Column:
    """Minutes of ``HH:MM`` or ``HH:MM:SS`` (seconds dropped); blank is null."""
    hours = F.try_element_at(F.split(text, ":"), F.lit(1)).try_cast("int")
    mins = F.try_element_at(F.split(text, ":"), F.lit(2)).try_cast("int")
    return F.when(hours.between(0, 23) & mins.between(0, 59), hours * 60 + mins)


def duration_label(minutes: Column) -> Column:
    """``1h 5m``, ``1h``, ``5m``; zero is ``0m``."""
    hours = F.floor(minutes / 60).cast("string")
    mins = (minutes % 60).cast("string")
    return (F.when((minutes >= 60) & (minutes % 60 != 0),
                   F.concat(hours, F.lit("h "), mins, F.lit("m")))
            .when(minutes >= 60, F.concat(hours, F.lit("h")))
            .otherwise(F.concat(mins, F.lit("m"))))
