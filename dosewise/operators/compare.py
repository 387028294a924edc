"""Comparing tables, id lists and results, and checking a cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dosewise.functions import filled, known
from dosewise.operators.derive import any_filled


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of every numeric column in two tables and the relative difference."""

    def means(t, name):
        cols = [f.name for f in t.schema.fields if isinstance(f.dataType, NumericType)]
        one = t.agg(*[F.avg(c).alias(c) for c in cols])
        return one.unpivot([], cols, "variable", name)

    joined = means(a, "mean_a").join(means(b, "mean_b"), "variable", "full")
    diff = F.try_divide(F.abs(F.col("mean_a") - F.col("mean_b")), F.col("mean_b"))
    return joined.withColumn("diff_rate", diff)


def compare_id_lists(a: DataFrame, b: DataFrame, key: str = "p_id") -> DataFrame:
    """Number of distinct ids in both lists and only in one of them."""
    ids = (
        a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
        .unionByName(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )
    return ids.agg(
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 0)).alias("only_a"),
        F.count_if((F.col("in_a") == 0) & (F.col("in_b") == 1)).alias("only_b"),
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("in_both"),
    )


def compare_values(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of ``a`` that differ from ``b`` in a column, missing values included,
    with the difference of numeric columns."""
    numeric = {f.name for f in a.schema.fields if isinstance(f.dataType, NumericType)}
    right = b.select(key, *[F.col(c).alias(f"{c}_2") for c in columns])
    joined = a.select(key, *columns).join(right, key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return joined.where(differs).withColumns(
        {f"{c}_diff": F.col(c) - F.col(f"{c}_2") for c in columns if c in numeric}
    )


def check_table(rows: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Checks as rows (check, value, ok): each is an aggregate and the test of
    its value, which is referred to by the check's name."""
    one = rows.agg(*[value.cast("bigint").alias(name) for name, (value, _) in checks.items()])
    pairs = [
        F.struct(F.lit(name).alias("check"), F.col(name).alias("value"), known(ok).cast("int").alias("ok"))
        for name, (_, ok) in checks.items()
    ]
    return one.select(F.inline(F.array(*pairs)))


def qc_assertions(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Cohort invariants: therapy flags exclude each other, an index date for all
    rows, index dates in the window, no market row before it."""
    flags = sum(
        (F.coalesce(F.col(c), F.lit(0)) for c in ("oral_anti_platelet", "ace_inhibitors", "beta_blockers",
                                                  "diabetes_insulin", "diabetes_other", "other_drugs", "market")),
        F.lit(0),
    )
    index = F.col("index_date")
    in_window = index.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    early = (F.col("market") == 1) & (F.col("trans_date") < index)
    return check_table(
        rows,
        {
            "min_flag_sum": (F.min(flags), F.col("min_flag_sum") == 1),
            "max_flag_sum": (F.max(flags), F.col("max_flag_sum") == 1),
            "null_index_rows": (F.count_if(index.isNull()), F.col("null_index_rows") == 0),
            "index_outside_window": (F.count_if(known(~in_window)), F.col("index_outside_window") == 0),
            "market_before_index": (F.count_if(known(early)), F.col("market_before_index") == 0),
            "n_patients": (F.count_distinct("p_id"), F.col("n_patients") > 0),
        },
    )


def products_per_molecule(rows: DataFrame) -> DataFrame:
    """Distinct (pack, product, molecule) list of the market rows."""
    return rows.where(F.col("market") == 1).select("fcc", "prod", "molecule").distinct()


def match_rates(rows: DataFrame, survey: DataFrame, any_of: Sequence[str], all_of: Sequence[str]) -> DataFrame:
    """How far a physician survey covers the claims: matched rows, rows with any
    and with all answers, matched physicians, patients and specialties."""
    s = survey.where(F.col("short_id").isNotNull())
    joined = rows.select("p_id", "shortcode", "doc_speciality").join(
        s, F.col("shortcode") == F.col("short_id"), "left"
    )
    hit, some = F.col("short_id").isNotNull(), any_filled(any_of)
    complete = F.lit(True)
    for c in all_of:
        complete = complete & filled(F.col(c))
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(hit).alias("matched_rows"),
        F.try_divide(F.count_if(hit), F.count(F.lit(1))).alias("match_rate"),
        F.count_if(some).alias("any_rows"),
        F.count_if(complete).alias("complete_rows"),
        F.count_distinct(F.when(some, F.col("shortcode"))).alias("any_physicians"),
        F.count_distinct(F.when(complete, F.col("shortcode"))).alias("complete_physicians"),
        F.count_distinct(F.when(some, F.col("p_id"))).alias("any_patients"),
        F.count_distinct(F.when(complete, F.col("p_id"))).alias("complete_patients"),
        F.count_distinct(F.when(some, F.col("doc_speciality"))).alias("any_specialties"),
    )
