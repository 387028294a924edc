"""Equi-joins. The physical choice is left to Catalyst and AQE: a side is
broadcast only when its estimated or measured size is small, and a hot key in a
sort-merge join is split at run time (see ``dosewise.session.tune``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in ``order``, which must decide every tie.

    Spark limits each group to one row before the shuffle as well, so a hot key
    does not reach a single task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def with_group_values(rows: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Detail rows plus group aggregates, missing keys forming a group.

    The aggregate is combined map-side and joined back, so the rows of a hot
    group never meet in one task as they would in a window over the group.
    """
    group = rows.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    group = group.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(group, same, "left").drop(*[f"_{k}" for k in keys])


def cohort_inner(
    rows: DataFrame, cohort: DataFrame, exclusions: DataFrame, first_day: int, last_day: int
) -> DataFrame:
    """Rows of cohort patients in a date range, minus an exclusion list."""
    in_range = rows.where(F.col("transactiondate").between(first_day, last_day))
    return anti_join(in_range.join(cohort, "p_id"), exclusions, "p_id")


def enrich_left(rows: DataFrame, lookup: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """All rows, with the columns of a lookup table that is unique by key."""
    return rows.join(lookup, on, "left")


def multi_left(base: DataFrame, others: Sequence[DataFrame], on: str = "p_id") -> DataFrame:
    out = base
    for o in others:
        out = out.join(o, on, "left")
    return out


def match_merge_full(tables: Sequence[DataFrame], on: str = "p_id") -> DataFrame:
    """Outer match-merge of tables unique by key; shared columns come from the
    later table where that has the key."""
    out = tables[0]
    for t in tables[1:]:
        shared = [c for c in t.columns if c in out.columns and c != on]
        right = t.withColumnsRenamed({c: f"_r_{c}" for c in shared}).withColumn("_hit", F.lit(1))
        out = out.join(right, on, "full")
        out = out.withColumns(
            {c: F.when(F.col("_hit") == 1, F.col(f"_r_{c}")).otherwise(F.col(c)) for c in shared}
        ).drop("_hit", *[f"_r_{c}" for c in shared])
    return out


def match_merge_left(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows kept; the right table is unique by key and loses missing keys."""
    right = right.where(F.col(right_key).isNotNull()).withColumnRenamed(right_key, left_key)
    return left.join(right, left_key, "left")


def semi_join(rows: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return rows.join(keys, on, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not listed; missing keys in the list change nothing."""
    return rows.join(keys, on, "left_anti")


def composite_key(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(on), how)


def attach_scalars(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """One-row statistics on every row, as a scalar subquery."""
    stats = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return rows.withColumn("_s", stats).select(*rows.columns, "_s.*")


def index_pack_lookup(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Molecule, pack size and strength of the index fill, one row per patient."""
    fills = rows.where((F.col("trans_date") == F.col("index_date")) & (F.col("market") == 1))
    one = first_per_key(fills.select("p_id", "fcc", "mol1"), ["p_id"], ["fcc", "mol1"])
    lookup = dictionary.select("fcc", "pack_size", "str_unit")
    return one.join(lookup, "fcc", "left").select("p_id", "mol1", "pack_size", "str_unit")


def first_match_lookup(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str, order: Sequence[str]) -> DataFrame:
    """Look up only the first match of each key, in the lookup's order."""
    first = first_per_key(lookup.where(F.col(lookup_key).isNotNull()), [lookup_key], order)
    return rows.join(first.withColumnRenamed(lookup_key, key), key, "left")


def fallback_lookup(rows: DataFrame, by_pack: DataFrame, by_product: DataFrame) -> DataFrame:
    """Median duration of the pack, else of the product; unresolved rows go."""
    pack = by_pack.select("fcc", "prod", F.col("median_duration").alias("pack_median"))
    product = by_product.select("prod", F.col("median_duration").alias("prod_median"))
    return (
        rows.join(pack, ["fcc", "prod"], "left")
        .join(product, "prod", "left")
        .withColumn("median_duration", F.coalesce("pack_median", "prod_median"))
        .where(F.col("median_duration").isNotNull())
        .drop("pack_median", "prod_median")
    )
