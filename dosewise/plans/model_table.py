"""The patient table behind the models: shares, covered days, compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.operators import aggregate as agg
from dosewise.operators.adherence import second_script_compliance
from dosewise.operators.derive import persistence_labels, pre_index_window
from dosewise.operators.joins import enrich_left, multi_left
from dosewise.operators.reshape import intersect_ids, pivot_wide
from dosewise.plans.pdc import PdcSettings, covered, fills_with_duration
from dosewise.sources import persist_stage
from dosewise.sources.claims import Tables


def model_table(rows: DataFrame, tables: Tables, add_on: str, settings: PdcSettings) -> DataFrame:
    """One row per patient with non-market history, an index supply between 80
    and 180 days and a second fill. ``rows`` are the indexed cohort claims, which
    are written once because six steps read them."""
    rows = persist_stage(
        rows.select(
            "p_id", "trans_date", "index_date", "market", "prod", "fcc", "atc", "mol1", "units", "pack_size", "shortcode"
        )
    )
    supply = agg.index_molecule(agg.days_supply_on_index(rows), add_on)
    compliance = second_script_compliance(supply, agg.second_fill(rows))
    history = pre_index_window(rows, settings.window_days)
    main = (
        history.where(F.col("market") != 1)
        .select("p_id")
        .distinct()
        .join(supply.where((F.col("days_supply_on_index") > 80) & (F.col("days_supply_on_index") < 180)), "p_id", "left_semi")
    )
    patients = intersect_ids(main, compliance.select("p_id").distinct())
    details = history.select("p_id", "shortcode").join(tables.doc_details, "shortcode", "left")
    fills = persist_stage(fills_with_duration(rows, settings))
    by_class = pivot_wide(covered(fills, settings), "p_id", "atc3", "pdc", settings.codes.split(), "pro_days_")
    overall = covered(fills, settings, "ALL").select("p_id", F.col("pdc").alias("pro_days_all"))
    wide = multi_left(
        patients,
        [
            agg.volume_share_by_specialty(details),
            by_class,
            overall,
            compliance.select("p_id", "molecule_on_index", "days_supply_on_index", "compliance"),
        ],
    )
    return enrich_left(wide, persistence_labels(tables.pat_persistence), "p_id")
