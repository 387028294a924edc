"""Refill gaps, covered days and second-script compliance.

Ordered-row windows run over (product, patient) or (class, patient). Their
input has one row per day (and pack) after ``distinct`` or a daily sum, so the
longest window is bounded by the days of the study times the packs of one
product, however many claims a single patient holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewise.functions import day_number, known
from dosewise.functions.ranks import order_statistics, value_counts
from dosewise.operators.joins import attach_scalars
from dosewise.sources import persist_stage


def refill_gap(fills: DataFrame) -> DataFrame:
    """Previous fill date and pack within (product, patient), and the gap in days."""
    w = Window.partitionBy("prod", "p_id").orderBy("trans_date", "fcc")
    return fills.withColumns(
        {
            "last_trans_date": F.lag("trans_date").over(w),
            "fcc_matched": F.lag("fcc").over(w),
        }
    ).withColumn("gap_between", F.datediff("trans_date", "last_trans_date"))


def median_gap_product(fills: DataFrame, dedup: bool = False) -> DataFrame:
    """Median refill gap per product, on pack rows or deduplicated by day."""
    if dedup:
        w = Window.partitionBy("prod", "p_id").orderBy("trans_date")
        days = fills.select("prod", "p_id", "trans_date").distinct()
        gaps = days.withColumn("gap_between", F.datediff("trans_date", F.lag("trans_date").over(w)))
    else:
        gaps = refill_gap(fills)
    return _median_gap(gaps, ["prod"])


def median_gap_pack(fills: DataFrame) -> DataFrame:
    """Median gap per (previous pack, product): the gap belongs to that pack."""
    gaps = refill_gap(fills).where(F.col("fcc_matched").isNotNull())
    return _median_gap(gaps, ["fcc_matched", "prod"]).withColumnRenamed("fcc_matched", "fcc")


def _median_gap(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    # gaps are whole days, so the exact median keeps a bounded table of day counts
    return (
        gaps.where(F.col("gap_between").isNotNull())
        .groupBy(*keys)
        .agg(F.median("gap_between").alias("median_duration"))
    )


def winsorize(rows: DataFrame, column: str, low: int = 5, high: int = 95) -> DataFrame:
    """Cap a column at its own percentiles (definition 5)."""
    cuts = order_statistics(value_counts(rows, column), column, [low, high])
    capped = F.least(F.greatest(F.col(column), F.col(f"p{low}")), F.col(f"p{high}"))
    return (
        attach_scalars(rows, cuts)
        .withColumn(column, F.when(F.col(column).isNotNull(), capped))
        .drop(f"p{low}", f"p{high}")
    )


def daily_duration(fills: DataFrame, label: str = "atc3") -> DataFrame:
    """Days bought per (class, patient, day): sum of median duration x units."""
    return fills.groupBy(label, "p_id", "index_date", "trans_date").agg(
        F.sum(F.col("median_duration") * F.col("units")).alias("actual_duration")
    )


def first_fill_lookback(daily: DataFrame, min_days: int, label: str = "atc3") -> DataFrame:
    """First fill per (class, patient) if at least ``min_days`` before the index."""
    return (
        daily.groupBy(label, "p_id")
        .agg(F.min("trans_date").alias("first_rx_date"), F.min("index_date").alias("_index"))
        .withColumn("total_n_days", F.datediff("_index", "first_rx_date"))
        .where(F.col("total_n_days") >= min_days)
        .drop("_index")
    )


def next_fill(daily: DataFrame, label: str = "atc3") -> DataFrame:
    w = Window.partitionBy(label, "p_id").orderBy("trans_date")
    return daily.withColumn("next_rxdate", F.lead("trans_date").over(w))


def coverage_episodes(daily: DataFrame, min_days: int, label: str = "atc3") -> DataFrame:
    """Episodes per (class, patient): number, begin, end, days and running days.

    An episode ends with its supply, the day before the next fill or, for the
    last one, the day before the index date, whichever is first. Surplus supply
    is not carried forward. The look-back test needs only the first fill, which
    the same window yields, so no second aggregate or join is made.
    """
    w = Window.partitionBy(label, "p_id").orderBy("trans_date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min("trans_date").over(upto)
    begin = day_number(F.col("trans_date"))
    stop = F.coalesce(day_number(F.col("next_rxdate")), day_number(F.col("index_date"))) - 1
    rows = daily.withColumns(
        {
            "episnum": F.row_number().over(w),
            "next_rxdate": F.lead("trans_date").over(w),
            "total_n_days": F.datediff("index_date", first),
        }
    ).where(F.col("total_n_days") >= min_days)
    rows = rows.withColumns(
        {"episbeg": begin, "episend": F.least(begin + F.col("actual_duration") - 1, stop)}
    ).withColumn("days_covered", F.col("episend") - F.col("episbeg") + 1)
    return rows.withColumn("cum_days_covered", F.sum("days_covered").over(upto))


def proportion_days_covered(daily: DataFrame, min_days: int, label: str = "atc3") -> DataFrame:
    """Covered days over days since the first fill, per class and patient."""
    return (
        coverage_episodes(daily, min_days, label)
        .groupBy(label, "p_id")
        .agg(F.sum("days_covered").alias("days_covered"), F.max("total_n_days").alias("total_n_days"))
        .withColumn("pdc", F.try_divide("days_covered", "total_n_days"))
    )


def pdc_summary(pdc: DataFrame, label: str = "atc3", percents: Sequence[int] = (5, 10, 25, 50, 75, 90, 95)) -> DataFrame:
    """Minimum, percentiles (definition 5) and maximum of the PDC per class.

    Ranking reads the table several times, so it is written once.
    """
    pdc = persist_stage(pdc.select(label, "pdc"))
    ends = pdc.groupBy(label).agg(F.min("pdc").alias("min"), F.max("pdc").alias("max"))
    marks = order_statistics(value_counts(pdc, "pdc", [label]), "pdc", percents, label)
    return ends.join(marks, label)


def second_script_compliance(supply: DataFrame, second: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Gap between the end of the index supply and the second fill; compliant
    unless it exceeds a share of the supply. A missing gap is compliant."""
    gap = F.datediff("second_date", "index_date") - F.col("days_supply_on_index")
    late = known(F.col("gap") > tolerance * F.col("days_supply_on_index"))
    return (
        supply.join(second, "p_id")
        .withColumn("gap", gap)
        .withColumn("compliance", F.when(late, 0).otherwise(1))
    )


def compliance_persistence(compliance: DataFrame, persistence: DataFrame, days: int = 180) -> DataFrame:
    """Persistence rate by compliance for patients with 80 < supply < 180 days."""
    supply = F.col("days_supply_on_index")
    return (
        compliance.where((supply > 80) & (supply < 180))
        .join(persistence, "p_id", "left")
        .groupBy("compliance")
        .agg(
            F.count_if(F.col("capped_days_treatment") >= days).alias("persist_pats"),
            F.count(F.lit(1)).alias("total_pats"),
        )
        .withColumn("proportion_persist", F.try_divide("persist_pats", "total_pats"))
    )
