"""Months and epoch times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column) -> Column:
    return F.trunc(c.cast("date"), "MM")


def month_index(c: Column) -> Column:
    """Months since year 0: neighbours differ by 1 whatever the calendar."""
    return F.year(c) * 12 + F.month(c)


def month_of_index(i: Column) -> Column:
    return F.make_date(F.floor((i - 1) / 12).cast("int"), ((i - 1) % 12 + 1).cast("int"), F.lit(1))


def epoch_millis(c: Column) -> Column:
    """A string of digits as epoch milliseconds; null for anything else (signs, fractions, words)."""
    return F.when(F.regexp_like(c, F.lit("^[0-9]{1,18}$")), c.cast("bigint"))


def timestamp_fields(ms: Column) -> tuple[Column, Column]:
    """Timestamp and month start (date) of epoch milliseconds; null for null and negative ones."""
    ts = F.when(ms >= 0, F.timestamp_millis(ms))
    return ts, F.trunc(ts.cast("date"), "MM")
