"""The patient mart: one row of covariates and labels per indexed patient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dosewise.functions import known, parse_number
from dosewise.operators import aggregate as agg
from dosewise.operators.derive import (
    ATC_FLAGS,
    atc_levels,
    code_flag_and_drop,
    drop_early_market,
    fixed_dummies,
    levels_of,
    persistence_labels,
    pre_index_window,
    sparse_dummies,
    therapy_cost_trx,
    therapy_flags,
)
from dosewise.operators.joins import index_pack_lookup, match_merge_left, multi_left
from dosewise.sources import persist_stage
from dosewise.sources.claims import Tables

SPECIALTIES = ("11", "21", "34", "60")
ATC3_LEVELS = ("A02B", "A10C", "A10J", "C07A", "C09A")
URBAN_LEVELS = (10, 26, 42, 58)


def patient_mart(
    tables: Tables,
    start: str,
    stems: Sequence[str],
    specialties: Sequence[str] = SPECIALTIES,
    atc3: Sequence[str] = ATC3_LEVELS,
    molecules: Sequence[str] | None = (),
    urban: Sequence[int] = URBAN_LEVELS,
) -> DataFrame:
    """Covariates from the history before the index date, the index fill and the
    main region and physician, with the persistence labels.

    Market molecules, and molecule, pack size and strength of the index fill, have
    any number of levels: they are sparse vectors, an array of level numbers a
    family (``mart_vectors`` tells their width). Listed molecules also get a 0/1
    column each, None stands for all of the data (few, see ``levels_of``).

    The claims are joined and written once for the index dates and the rows; the
    indexed claims feed six aggregations, so they are written once too. Tables that share input are one aggregate each instead of one per covariate group.
    """
    base = persist_stage(
        drop_early_market(tables.rx, start).select(
            "p_id", "trans_date", "transactiondate", "fcc", "atc", "mol1", "otc", "units", "rsp", "market",
            "shortcode", "doc_speciality", "doc_gender", "region_doc", "ddms_pha", "transactiontype", "dci_vos",
            "p_gender", "capped_days_treatment",
        )
    )
    index = agg.index_date(base, start, variant="after_start")
    rows = persist_stage(base.join(index, "p_id"))
    market = known(F.col("market") == 1)
    molecules = levels_of(rows.where(market), "mol1") if molecules is None else molecules
    history = therapy_cost_trx(
        therapy_flags(atc_levels(pre_index_window(rows, None).where(F.col("market") == 0)), stems)
    )
    before = history.groupBy("p_id").agg(
        *agg.total_columns(),
        *agg.feature_columns(),
        *[F.max(c).alias(f"{c}_Max") for c in ("oral_anti_platelet", *ATC_FLAGS)],
        *agg.level_columns("atc3", "atc3_", atc3),
        *agg.level_columns("doc_speciality", "spec", specialties),
    )
    # apart, because exact distinct counts expand their input once per column
    distinct = history.groupBy("p_id").agg(*agg.distinct_columns())
    overall = rows.groupBy("p_id").agg(
        F.min("index_date").alias("index_date"),
        *agg.gender_columns(),
        *agg.level_columns("doc_speciality", "market_spec", specialties, market),
        *agg.level_columns("doc_gender", "market_doc_gender", (1, 2), market),
        *agg.level_columns("mol1", "mol_", molecules, market),
        *agg.level_columns("doc_speciality", "doc_speciality_", specialties, agg.at_index()),
    )
    physician = agg.impute_graduation(agg.main_physician(rows), tables.doc_graduation)
    physician = match_merge_left(physician, agg.physician_gender(rows), "main_physician", "main_physician")
    pack = index_pack_lookup(rows, tables.product_dict).withColumnRenamed("mol1", "mol_start")
    vectors = sparse_dummies(persist_stage(_levels(rows, tables)))
    vectors = vectors.groupBy("p_id").pivot("family", list(FAMILIES)).agg(F.first("numbers"))
    vectors = vectors.withColumnsRenamed({k: f"{k}_levels" for k in FAMILIES})
    wide = multi_left(
        overall, [before, distinct, agg.mean_doctor_gender(history), agg.main_region(rows), physician, pack, vectors]
    )
    demo = tables.sociodemo.withColumn("meyon", parse_number(F.col("meyon")))
    wide = match_merge_left(wide, demo, "main_region_pat", "brick")
    wide = match_merge_left(wide, tables.doc_sales, "main_physician", "shortcode")
    wide = fixed_dummies(wide, "urb", "urban_", urban)
    final = code_flag_and_drop(
        wide,
        "active",
        "physician_active",
        ["mean_doc_gender", "active"],
        ["main_physician", "main_region_pat", "share_main_region_pat", "active"],
    )
    labels = persistence_labels(tables.pat_persistence).drop("capped_days_treatment")
    return final.join(labels, "p_id", "left")


def mart_levels(tables: Tables, start: str) -> DataFrame:
    """(p_id, family, level): every market molecule a patient filled, and the
    molecule, pack size and strength of the index fill.

    The dummies of the mart in long form: all levels of the data, any number of
    them, a row for each one that is 1.
    """
    base = drop_early_market(tables.rx, start)
    index = agg.index_date(base, start, variant="after_start")
    needed = base.where("market = 1").select("p_id", "trans_date", "fcc", "mol1", "market")
    return _levels(persist_stage(needed.join(index, "p_id")), tables)


#: Families of levels, in the order of the mart's columns.
FAMILIES = ("market_molecule", "start_molecule", "pack_size", "strength")


def _levels(rows: DataFrame, tables: Tables) -> DataFrame:
    pack = index_pack_lookup(rows, tables.product_dict)
    market = rows.where("market = 1")
    molecules = market.select("p_id", F.lit(FAMILIES[0]).alias("family"), F.col("mol1").alias("level")).distinct()
    values = zip(FAMILIES[1:], ("mol1", "pack_size", "str_unit"), strict=True)
    first = pack.select("p_id", F.inline(F.array(*(F.struct(F.lit(k).alias("family"), F.col(c).cast("string").alias("level")) for k, c in values))))
    return molecules.unionByName(first).where(F.col("level").isNotNull())


def mart_vectors(tables: Tables, start: str) -> DataFrame:
    """The same as sparse vectors: (p_id, family, width, numbers)."""
    return sparse_dummies(persist_stage(mart_levels(tables, start)))


#: Columns that are no covariates: keys, dates, and what the labels are made of.
NO_COVARIATES = ("p_id", "index_date", "persistence", "persistence_3m", "persistence_6m", "persistence_9m")


def covariate_list(mart: DataFrame) -> list[str]:
    """The numeric columns of the mart that may explain a label."""
    return [f.name for f in mart.schema.fields if isinstance(f.dataType, NumericType) and f.name not in NO_COVARIATES]
