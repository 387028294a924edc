"""Sorting, set operations and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.operators.derive import clean_name


def sort_desc(rows: DataFrame, measure: str, ties: Sequence[str]) -> DataFrame:
    return rows.orderBy(F.col(measure).desc(), *ties)


def top_k(rows: DataFrame, k: int, measure: str, ties: Sequence[str]) -> DataFrame:
    return sort_desc(rows, measure, ties).limit(k)


def order_by_abs(rows: DataFrame, measure: str, ties: Sequence[str] = ()) -> DataFrame:
    return rows.orderBy(F.abs(measure).desc_nulls_last(), *ties)


def union_distinct(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.distinct()


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def stack_rows(*tables: DataFrame) -> DataFrame:
    """Append tables by column name; a column one of them lacks is missing there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def delete_where(rows: DataFrame, ids: DataFrame, key: str, condition: Column) -> DataFrame:
    """Delete rows that meet a condition or whose key is listed."""
    kept = rows.where(~F.coalesce(condition, F.lit(False)))
    return kept.join(ids, key, "left_anti")


def pivot_wide(rows: DataFrame, key: str, column: str, value: str, levels: Sequence[str], prefix: str) -> DataFrame:
    """One column per given level, named with the prefix, one row per key."""
    wide = rows.groupBy(key).pivot(column, list(levels)).agg(F.first(value))
    return wide.withColumnsRenamed({v: f"{prefix}{clean_name(v)}" for v in levels})


def transpose_stats(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), name: str = "variable", value: str = "value") -> DataFrame:
    """Columns to rows, as doubles."""
    typed = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keys), list(columns), name, value)
