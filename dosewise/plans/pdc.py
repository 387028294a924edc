"""Proportion of days covered per therapy class before the index date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators.adherence import (
    daily_duration,
    median_gap_pack,
    median_gap_product,
    proportion_days_covered,
    winsorize,
)
from dosewise.operators.aggregate import rare_products
from dosewise.operators.derive import atc_levels, pre_index_window
from dosewise.operators.joins import anti_join, fallback_lookup
from dosewise.sources import code_list_filter, persist_stage


@dataclass(frozen=True)
class PdcSettings:
    # fixed values: the twenty therapy classes
    codes: str = "A02B C07A B01C N05C N06A C03A M02A C08A C09A A10J R06A R03F H03A R03G N05A C09B N03A C07B C09C C09D"
    #: products of so few patients are left out; 0: none are, None: those with the fewest
    rare_limit: int | None = 5
    window_days: int | None = 360
    lookback_days: int = 60
    dedup_products: bool = True


def durations(rows: DataFrame, s: PdcSettings) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Rare products (None: no limit on them), and capped median durations by pack and by product.

    The distinct fills feed three steps and the medians (one row per pack or
    product) two each, so they are written once.
    """
    fills = persist_stage(code_list_filter(atc_levels(rows), s.codes))
    rare = None if s.rare_limit == 0 else rare_products(fills, s.rare_limit)
    kept = fills if rare is None else anti_join(fills, rare, "prod")
    pack = winsorize(persist_stage(median_gap_pack(kept)), "median_duration")
    product = winsorize(persist_stage(median_gap_product(kept, s.dedup_products)), "median_duration")
    return rare, pack, product


def fills_with_duration(rows: DataFrame, s: PdcSettings) -> DataFrame:
    """Pre-index fills in the listed classes, each with its median duration.

    ``rows`` are the claims of indexed patients.
    """
    rare, pack, product = durations(rows, s)
    before = pre_index_window(atc_levels(rows), s.window_days)
    before = before.where(F.col("atc3").isin(s.codes.split()))
    before = before.select("p_id", "index_date", "trans_date", "prod", "fcc", "atc3", "units")
    if rare is not None:
        before = anti_join(before, rare, "prod")
    return fallback_lookup(before, pack, product)


def covered(fills: DataFrame, settings: PdcSettings = PdcSettings(), all_classes: str | None = None) -> DataFrame:
    """PDC per (class, patient); ``all_classes`` names one label for all classes."""
    if all_classes is not None:
        fills = fills.withColumn("atc3", F.lit(all_classes))
    return proportion_days_covered(daily_duration(fills), settings.lookback_days)


def build_pdc(rows: DataFrame, settings: PdcSettings = PdcSettings(), all_classes: str | None = None) -> DataFrame:
    return covered(fills_with_duration(rows, settings), settings, all_classes)
