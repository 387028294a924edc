"""Features for profiling the cohort: index fill, prior therapies and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from dosewise.operators import aggregate as agg
from dosewise.operators.derive import (
    COST_NAMES,
    drop_early_market,
    fill_missing,
    fixed_dummies,
    persistence_labels,
    pre_index_window,
    therapy_cost_trx,
    therapy_flags,
)
from dosewise.operators.joins import first_per_key, multi_left
from dosewise.sources import persist_stage
from dosewise.sources.claims import Tables


def profile_features(tables: Tables, start: str, stems: Sequence[str], specialties: Sequence[str]) -> DataFrame:
    """One row per indexed patient of the distinct claims, of which the columns
    that are needed are written once."""
    needed = ("p_id", "trans_date", "market", "doc_speciality", "mol1", "atc", "units", "rsp")
    claims = persist_stage(drop_early_market(tables.distinct_rx, start).select(*needed))
    index = agg.index_date(claims, start, variant="after_start")
    rows = claims.join(index, "p_id")
    fill = first_per_key(
        agg.index_fills(rows).select("p_id", "doc_speciality", "mol1"), ["p_id"], ["doc_speciality", "mol1"]
    )
    fill = fixed_dummies(fill, "doc_speciality", "index_spec", specialties).drop("doc_speciality")
    history = pre_index_window(rows, None).where(rows["market"] == 0)
    features = agg.pre_index_features(therapy_cost_trx(therapy_flags(history, stems, blank_atc_is_other=True)))
    labels = persistence_labels(tables.pat_persistence).drop("capped_days_treatment")
    wide = multi_left(index, [fill.withColumnRenamed("mol1", "index_molecule"), features, labels])
    names = COST_NAMES.values()
    zero = [f"pre_{s}{x}" for s in names for x in ("", "_cost", "_trx")]
    return fill_missing(wide, dict.fromkeys(zero, 0))
