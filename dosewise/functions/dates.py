"""Dates as the claims tables carry them: integers ``yyyymmdd`` and day counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date_int(c: Column) -> Column:
    """Integer ``yyyymmdd`` to date; an impossible date is missing."""
    return F.try_to_date(c.cast("string"), "yyyyMMdd")


def date_to_int(c: Column) -> Column:
    """Date to integer ``yyyymmdd``, by arithmetic rather than by formatting."""
    return F.year(c) * 10000 + F.month(c) * 100 + F.day(c)


def day_number(c: Column) -> Column:
    """Days since 1970-01-01 as a double, so durations may be fractional."""
    return F.unix_date(c).cast("double")


def parse_stamp_text(c: Column) -> Column:
    """Date of text such as ``2014-10-30 13:45:35`` (first ten characters)."""
    return F.try_to_date(F.substring(F.ltrim(c), 1, 10), "yyyy-MM-dd")
