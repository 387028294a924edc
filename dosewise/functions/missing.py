"""Column helpers for the missing-value rules of the claims programs.

A missing number sorts below every number, so ``missing < x`` holds; a blank
string is missing; a comparison the other way round never holds for missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Trailing blanks do not count and an empty string is missing."""
    return F.nullif(F.rtrim(c), F.lit(""))


def below(c: Column, x) -> Column:
    """``c < x`` where a missing ``c`` is below everything."""
    return c.isNull() | (c < x)


def at_most(c: Column, x) -> Column:
    return c.isNull() | (c <= x)


def known(cond: Column) -> Column:
    """Three-valued condition to a plain one: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """0/1 integer of a condition, unknown counts as 0."""
    return known(cond).cast("int")


def one_of(c: Column, values: Iterable) -> Column:
    return known(c.isin(list(values)))


def filled(c: Column) -> Column:
    """True for a non-missing value; blank strings are missing."""
    return known(F.length(F.rtrim(c.cast("string"))) > 0)


def parse_number(c: Column) -> Column:
    """Number from text, thousands separators allowed, anything else missing."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")
