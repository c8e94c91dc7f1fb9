"""Calendar arithmetic on DATE columns; weeks start on Monday."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_A_MONDAY = dt.date(1970, 1, 5)


def iso_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def parse_iso(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def day_type(d: Column) -> Column:
    return F.when(F.weekday(d) >= 5, "weekend").otherwise("weekday")


def week_start(d: Column) -> Column:
    return F.trunc(d, "week")


def week_end(d: Column) -> Column:
    return F.date_add(week_start(d), 6)


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def month_end(d: Column) -> Column:
    return F.last_day(d)


def period_start(period_type: Column, d: Column) -> Column:
    """Start of the week or month that holds ``d``; the day itself for daily."""
    return (F.when(period_type == "weekly", week_start(d))
            .when(period_type == "monthly", month_start(d))
            .otherwise(d))


def period_end(period_type: Column, d: Column) -> Column:
    return (F.when(period_type == "weekly", week_end(d))
            .when(period_type == "monthly", month_end(d))
            .otherwise(d))


def days_between(start: Column, end: Column) -> Column:
    """Every day of an inclusive range, as an array."""
    return F.sequence(start, end, F.expr("interval 1 day"))


def weeks_touching(start: Column, end: Column) -> Column:
    return F.sequence(week_start(start), week_start(end), F.expr("interval 7 days"))


def months_touching(start: Column, end: Column) -> Column:
    return F.sequence(month_start(start), month_start(end), F.expr("interval 1 month"))


def _weekdays_before(d: Column) -> Column:
    days = F.date_diff(d, F.lit(_A_MONDAY))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def weekdays_in(start: Column, end: Column) -> Column:
    """Monday-to-Friday days of an inclusive range, in closed form."""
    return _weekdays_before(F.date_add(end, 1)) - _weekdays_before(start)


def weekends_in(start: Column, end: Column) -> Column:
    return F.date_diff(end, start) + 1 - weekdays_in(start, end)


def grid_row(d: Column) -> Column:
    """Row of the Monday-first month grid, from 0."""
    return F.floor((F.weekday(month_start(d)) + F.dayofmonth(d) - 1) / 7).cast("int")


def grid_col(d: Column) -> Column:
    """Column of the Monday-first month grid, 0 to 6."""
    return F.weekday(d)


def long_label(d: Column) -> Column:
    return F.date_format(d, "EEEE, MMMM d")


def short_label(d: Column) -> Column:
    return F.date_format(d, "EEE, MMM d")


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMMM yyyy")


def weeks_from(as_of: Column, d: Column) -> Column:
    return (F.date_diff(week_start(d), week_start(as_of)) / 7).cast("int")


def months_from(as_of: Column, d: Column) -> Column:
    return ((F.year(d) - F.year(as_of)) * 12 + F.month(d) - F.month(as_of)).cast("int")


def shift_weeks(d: Column, k) -> Column:
    """Monday of the week ``k`` weeks away."""
    return F.date_add(week_start(d), F.lit(k) * 7)


def shift_months(d: Column, k) -> Column:
    """First day of the month ``k`` months away."""
    return F.add_months(month_start(d), F.lit(k))


def offset_label(offset: Column, unit: str) -> Column:
    """``This week``, ``3 weeks ago``, ``In 1 week``."""
    size = F.abs(offset)
    counted = F.concat(size.cast("string"), F.lit(f" {unit}"),
                       F.when(size == 1, "").otherwise("s"))
    return (F.when(offset == 0, f"This {unit}")
            .when(offset < 0, F.concat(counted, F.lit(" ago")))
            .otherwise(F.concat(F.lit("In "), counted)))


def local_date(instant: Column, zone: Column) -> Column:
    """The owner's calendar day of an instant."""
    return F.to_date(F.from_utc_timestamp(instant, zone))
