"""Scans, sinks, row-level derivations, sorting, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.bindings.registry import query, rounded, tidy
from dosewise.functions import date_to_int
from dosewise.operators import aggregate as agg
from dosewise.operators import derive, reshape
from dosewise.operators.stats import corr_with_target
from dosewise.plans.cohort import INDEX_START
from dosewise.session import scratch_dir
from dosewise.sources import code_list_filter, export_csv, persist_stage, scan_csv, scan_table

CODES = "A02B C07A C09A A10J"
CODES_SQL = "('A02B','C07A','C09A','A10J')"
SPECIALTIES = ("11", "21", "34", "60")
STEMS = ("red",)

# ---- sources and sinks ---------------------------------------------------------------


@query("scan_csv", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer", raw=True)
def scan_csv_query(t, c):
    df = t.read("customer")
    path = export_csv(df, scratch_dir(t.spark))
    return scan_csv(t.spark, path, df.schema)


@query("scan_table", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier", raw=True)
def scan_table_query(t, c):
    return scan_table(t.spark, f"{t.folder}/supplier.parquet")


@query(
    "code_list_filter",
    f"select distinct prod, fcc, p_id, trans_date, substr(ltrim(atc),1,4) as atc3 from base where substr(ltrim(atc),1,4) in {CODES_SQL}",
)
def code_list_filter_query(t, c):
    return code_list_filter(derive.atc_levels(c.base), CODES)


@query(
    "export_csv",
    "select cast(p_id as int) as p_id, capped_days_treatment, cast(index_yyyymmdd as int) as index_yyyymmdd from "
    "(select p.*, cast(strftime(index_date,'%Y%m%d') as int) as index_yyyymmdd from pat_persistence p left join idx using (p_id))",
)
def export_csv_query(t, c):
    df = t.pat_persistence.join(
        c.index.select("p_id", date_to_int(F.col("index_date")).alias("index_yyyymmdd")), "p_id", "left"
    )
    path = export_csv(df, scratch_dir(t.spark))
    return scan_csv(t.spark, path, sampling_ratio=1.0)


@query("persist_stage", "select p_id, index_date from idx")
def persist_stage_query(t, c):
    return persist_stage(c.index)


# ---- projections and predicates ----------------------------------------------------------


@query("rx_parse_date", "select p_id, rx_id, transactiondate, trans_date from rx")
def rx_parse_date(t, c):
    return derive.add_trans_date(t.rx.select("p_id", "rx_id", "transactiondate"))


@query("rx_date_to_int", "select p_id, fcc, cast(strftime(trans_date,'%Y%m%d') as int) as day_int from rx")
def rx_date_to_int(t, c):
    return derive.add_date_int(t.rx, "trans_date", "day_int").select("p_id", "fcc", "day_int")


@query(
    "therapy_flags",
    "select p_id, fcc, trans_date, oral_anti_platelet, ace_inhibitors, beta_blockers, diabetes_insulin, diabetes_other, other_drugs from flags",
)
def therapy_flags(t, c):
    return derive.therapy_flags(t.rx, STEMS).select("p_id", "fcc", "trans_date", *derive.THERAPIES)


_cost_sql = ", ".join(
    f"round(case when {f}=1 then rsp*units else 0 end,6) as {s}_cost, case when {f}=1 then 1 else 0 end as {s}_trx"
    for f, s in derive.COST_NAMES.items()
)


@query("therapy_cost_trx", f"select p_id, fcc, trans_date, {_cost_sql} from flags")
def therapy_cost_trx(t, c):
    out = derive.therapy_cost_trx(derive.therapy_flags(t.rx, STEMS))
    names = derive.COST_NAMES.values()
    out = out.select(
        "p_id", "fcc", "trans_date", *[f"{s}_cost" for s in names], *[f"{s}_trx" for s in names]
    )
    return rounded(out, [f"{s}_cost" for s in names])


@query("drop_early_market", "select p_id, trans_date, market, fcc, rx_id from base")
def drop_early_market(t, c):
    return derive.drop_early_market(t.rx, INDEX_START).select("p_id", "trans_date", "market", "fcc", "rx_id")


@query(
    "atc_levels",
    "select p_id, fcc, atc, substr(ltrim(atc),1,3) as atc2, substr(ltrim(atc),1,4) as atc3 from rx",
)
def atc_levels(t, c):
    return derive.atc_levels(t.rx.select("p_id", "fcc", "atc"))


@query(
    "recode_molecule",
    "select p_id, fcc, prod, mol1, case when m='BLUE BOLT' then null else m end as molecule from "
    "(select *, case when prod='ECONOMY-1' then 'COMBI ONE' when mol1='RED RING' then 'RING' else mol1 end as m from rx)",
)
def recode_molecule(t, c):
    rows = t.rx.select("p_id", "fcc", "prod", "mol1")
    return derive.recode_molecule(rows, {"ECONOMY-1": "COMBI ONE"}, {"RED RING": "RING"}, "BLUE BOLT")


@query(
    "specialty_group",
    "select shortcode, doc_speciality, case when doc_speciality in ('11','34') then 'GP' "
    "when doc_speciality is null or doc_speciality in ('60','90') then 'Unknown' else 'Non-GP' end as spec_group from rx",
)
def specialty_group(t, c):
    return t.rx.select("shortcode", "doc_speciality").withColumn(
        "spec_group", derive.specialty_group(F.col("doc_speciality"))
    )


@query(
    "one_hot",
    "select o_orderkey, o_orderpriority, "
    + ", ".join(
        f"case when o_orderpriority='{v}' then 1 else 0 end as prio_{v.replace('-', '_').replace(' ', '_')}"
        for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + " from orders",
    raw=True,
)
def one_hot(t, c):
    return derive.one_hot(t.read("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "prio_")


@query(
    "fixed_dummies",
    "select p_id, fcc, rx_id, "
    + ", ".join(
        f"case when doc_speciality='{v}' then 1 else 0 end as spec{v}, "
        f"case when doc_speciality='{v}' and market=1 then 1 else 0 end as market_spec{v}"
        for v in SPECIALTIES
    )
    + " from rx",
)
def fixed_dummies(t, c):
    rows = t.rx.select("p_id", "fcc", "rx_id", "doc_speciality", "market")
    return derive.fixed_dummies(rows, "doc_speciality", "spec", SPECIALTIES, "market_spec").drop("doc_speciality", "market")


@query(
    "fill_missing",
    "select p_id, fcc, coalesce(p_gender,999) as p_gender, coalesce(region_doc,0) as region_doc from rx",
)
def fill_missing(t, c):
    return derive.fill_missing(
        t.rx.select("p_id", "fcc", "p_gender", "region_doc"), {"p_gender": derive.UNKNOWN_GENDER, "region_doc": 0}
    )


@query(
    "persistence_labels",
    "select p_id, capped_days_treatment, "
    + ", ".join(
        f"case when capped_days_treatment/30>={m} then 1 else 0 end as persistence_{m}m" for m in (3, 6, 9)
    )
    + " from pat_persistence",
)
def persistence_labels(t, c):
    return derive.persistence_labels(t.pat_persistence)


@query(
    "split_outputs",
    "select p_id, fcc, rx_id, trans_date, index_date, case when trans_date<index_date and market=0 then 'pre_index' "
    "when trans_date<index_date then 'invalid' else 'market_only' end as stage from indexed",
)
def split_outputs(t, c):
    return derive.split_outputs(c.indexed).select("p_id", "fcc", "rx_id", "trans_date", "index_date", "stage")


@query(
    "parse_number",
    "select o_orderkey, case when o_orderpriority<>'4-NOT SPECIFIED' then round(o_totalprice,2) end as price from orders",
    raw=True,
)
def parse_number(t, c):
    text = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Unknown").otherwise(F.format_number("o_totalprice", 2))
    rows = t.read("orders").select("o_orderkey", text.alias("price"))
    return derive.numbers_from_text(rows, ["price"], ["unknown"])


@query(
    "code_flag_and_drop",
    "select shortcode, sales, case active when 'Y' then 1 when 'N' then 0 end as physician_active "
    "from doc_sales where trim(active)<>'' and sales is not null",
)
def code_flag_and_drop(t, c):
    return derive.code_flag_and_drop(t.doc_sales, "active", "physician_active", ["active", "sales"], ["active"])


@query(
    "row_missing_count",
    "select p_id, fcc, rx_id, cast((doc_speciality is null)::int+(region_doc is null)::int+(p_gender is null)::int as int) as n_missing, "
    "(doc_speciality is not null or region_doc is not null)::int as any_known from rx",
)
def row_missing_count(t, c):
    rows = derive.row_missing_count(t.rx, ["doc_speciality", "region_doc", "p_gender"])
    some = derive.any_filled(["doc_speciality", "region_doc"]).cast("int")
    return rows.select("p_id", "fcc", "rx_id", "n_missing", some.alias("any_known"))


@query("select_by_regex", "select p_id, rx_id, doc_speciality, doc_gender, region_doc from rx")
def select_by_regex(t, c):
    return derive.select_by_regex(t.rx, "^doc_|^region", ["p_id", "rx_id"])


@query("distinct_rows", "select distinct p_id, prod, trans_date, market from rx")
def distinct_rows(t, c):
    return t.rx.select("p_id", "prod", "trans_date", "market").distinct()


@query(
    "pre_index_window",
    "select p_id, fcc, rx_id, trans_date, index_date from indexed where trans_date<index_date and trans_date>=index_date-360",
)
def pre_index_window(t, c):
    c = c.staged("fcc", "rx_id")
    return derive.pre_index_window(c.indexed, 360).select("p_id", "fcc", "rx_id", "trans_date", "index_date")


@query(
    "rename_retype",
    "select cast(s_suppkey as varchar) as physician_id, s_name as physician_name, s_nationkey as practice_id from supplier",
    raw=True,
)
def rename_retype(t, c):
    return derive.rename_retype(
        t.read("supplier"),
        {"s_suppkey": "physician_id", "s_name": "physician_name", "s_nationkey": "practice_id"},
        ["s_suppkey"],
        ["s_acctbal"],
    )


# ---- sorting -------------------------------------------------------------------------


@query("sort_desc", "select p_id, count(*) as n_rows from rx group by p_id order by n_rows desc, p_id")
def sort_desc(t, c):
    return reshape.sort_desc(t.rx.groupBy("p_id").agg(F.count(F.lit(1)).alias("n_rows")), "n_rows", ["p_id"])


@query("top_k", "select p_id, count(*) as n_rows from rx group by p_id order by n_rows desc, p_id limit 10")
def top_k(t, c):
    return reshape.top_k(t.rx.groupBy("p_id").agg(F.count(F.lit(1)).alias("n_rows")), 10, "n_rows", ["p_id"])


@query(
    "order_by_abs",
    "select variable, round(r,6) as pearson from (select 'units' as variable, corr(units,market) as r from rx "
    "union all select 'rsp', corr(rsp,market) from rx union all select 'pack_size', corr(pack_size,market) from rx) order by abs(r) desc",
)
def order_by_abs(t, c):
    table = corr_with_target(t.rx, "market", ["units", "rsp", "pack_size"])
    return rounded(reshape.order_by_abs(table, "pearson", ["variable"]), ["pearson"])


# ---- set operations --------------------------------------------------------------------


def _big_units(t):
    return agg.outlier_patients(t.rx, 6)


BIG_UNITS_SQL = (
    "big_units as (select distinct p_id from rx where rx_id>6 or units>6 "
    "union select p_id from rx group by p_id, trans_date having sum(units)>6)"
)


@query(
    "union_distinct", "select p_id from big_units union select p_id from exclusions where p_id is not null", BIG_UNITS_SQL
)
def union_distinct(t, c):
    return reshape.union_distinct(_big_units(t), t.exclusions.where(F.col("p_id").isNotNull()))


@query("intersect_ids", "select p_id from big_units intersect select p_id from idx", BIG_UNITS_SQL)
def intersect_ids(t, c):
    return reshape.intersect_ids(_big_units(t), c.index.select("p_id"))


@query(
    "stack_rows",
    "select p_id, index_date, cast(null as int) as capped_days_treatment from idx union all select p_id, null, capped_days_treatment from pat_persistence",
)
def stack_rows(t, c):
    return reshape.stack_rows(c.index, t.pat_persistence)


@query("set_difference", "select p_id from pat_persistence except select p_id from idx")
def set_difference(t, c):
    return reshape.set_difference(t.pat_persistence.select("p_id"), c.index.select("p_id"))


@query(
    "delete_where",
    f"select p_id, fcc, rx_id, trans_date from rx where not (market=1 and trans_date<date '{INDEX_START}') "
    "and p_id not in (select p_id from exclusions where p_id is not null)",
)
def delete_where(t, c):
    early = (F.col("market") == 1) & (F.col("trans_date") < F.lit(INDEX_START).cast("date"))
    return reshape.delete_where(t.rx, t.exclusions, "p_id", early).select("p_id", "fcc", "rx_id", "trans_date")


# ---- reshape ---------------------------------------------------------------------------


@query(
    "pivot_wide",
    "select p_id, "
    + ", ".join(f"max(case when atc3='{v}' then u end) as units_{v}" for v in CODES.split())
    + " from (select p_id, substr(ltrim(atc),1,4) as atc3, round(sum(units),4) as u from base group by 1,2) group by p_id",
)
def pivot_wide(t, c):
    units = (
        derive.atc_levels(c.base).groupBy("p_id", "atc3").agg(tidy(F.sum("units"), 4).alias("u"))
    )
    return reshape.pivot_wide(units, "p_id", "atc3", "u", CODES.split(), "units_")


@query(
    "transpose_stats",
    "select prod, 'n' as variable, cast(count(*) as double) as value from rx group by prod "
    "union all select prod, 'patients', cast(count(distinct p_id) as double) from rx group by prod "
    "union all select prod, 'mean_units', round(avg(units),6) from rx group by prod",
)
def transpose_stats(t, c):
    wide = t.rx.groupBy("prod").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("p_id").alias("patients"),
        tidy(F.avg("units")).alias("mean_units"),
    )
    return reshape.transpose_stats(wide, ["n", "patients", "mean_units"], ["prod"])
