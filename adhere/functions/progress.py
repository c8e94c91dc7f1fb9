"""Percentages, heat levels and goal measures.

Percentages divide first and multiply after, in doubles, and round half up:
29 of 200 is 14, not 15.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import TARGET_TYPE
from .clock import duration_label


def _rounded_percent(part: Column, whole: Column) -> Column:
    ratio = part.cast("double") / whole.cast("double")
    return F.floor(ratio * F.lit(100.0) + F.lit(0.5)).cast("int")


def percent(done: Column, planned: Column) -> Column:
    """Uncapped; 0 when nothing was planned."""
    return F.when(F.coalesce(planned, F.lit(0)) == 0, 0) \
        .otherwise(_rounded_percent(done, planned))


def heat_level(done: Column, planned: Column) -> Column:
    """0 nothing done, 1 below half, 2 below all, 3 all. Unplanned work is 1."""
    ratio = F.when(planned == 0, F.lit(0.0)) \
        .otherwise(done.cast("double") / planned.cast("double"))
    return (F.when(done == 0, 0).when(ratio >= 1, 3).when(ratio >= 0.5, 2).otherwise(1))


def goal_target_unit(metric: Column, target: Column) -> Column:
    """Target in the unit of the actual: minutes for hour goals."""
    return F.when(metric == "hours", target.cast("double") * 60) \
        .otherwise(target.cast("double"))


def goal_percent(actual: Column, metric: Column, target: Column) -> Column:
    """Capped at 100; 0 for a goal without target."""
    unit = goal_target_unit(metric, target)
    return F.when(F.coalesce(unit, F.lit(0.0)) == 0, 0) \
        .otherwise(F.least(F.lit(100), _rounded_percent(actual, unit)))


def plain_number(target: Column) -> Column:
    """A decimal without trailing zeros: 2.50 is ``2.5``, 3.00 is ``3``."""
    return F.regexp_replace(target.cast(TARGET_TYPE).cast("string"), r"\.?0+$", "")


def goal_label(actual: Column, metric: Column, target: Column) -> Column:
    """``1h 30m of 2.5h`` or ``3 of 5 done``."""
    return F.when(metric == "hours",
                  F.concat(duration_label(actual), F.lit(" of "), plain_number(target),
                           F.lit("h"))) \
        .otherwise(F.concat(actual.cast("string"), F.lit(" of "), plain_number(target),
                            F.lit(" done")))
