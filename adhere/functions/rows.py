"""Turning one row into several without a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def several_rows(*records: dict[str, Column]) -> Column:
    """A generator that emits one output row per record."""
    return F.inline(F.array(*[
        F.struct(*[value.alias(name) for name, value in record.items()])
        for record in records]))
