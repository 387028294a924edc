"""Patient-level aggregates and cohort plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.bindings.registry import query, rounded, tidy
from dosewise.operators import aggregate as agg
from dosewise.operators import derive
from dosewise.operators.joins import first_per_key, with_group_values
from dosewise.operators.stats import corr_with_target
from dosewise.plans import cohort as cohort_plan
from dosewise.plans.cohort import FIRST_DAY, INDEX_END, INDEX_START, LAST_DAY
from dosewise.plans.patient_mart import ATC3_LEVELS, FAMILIES, URBAN_LEVELS, mart_levels, mart_vectors, patient_mart
from dosewise.plans.profile_features import profile_features

STEMS = ("red",)
SPECIALTIES = ("11", "21", "34", "60")

UTILISATION_SQL = """count(*) as cnt_tx, count(distinct transactiondate) as cnt_tx_days, count(distinct shortcode) as cnt_docs,
 count(distinct doc_speciality) as cnt_specialties, count(distinct ddms_pha) as cnt_pharmacies, count(distinct fcc) as cnt_fcc,
 count(distinct atc) as cnt_atc, count(distinct otc) as cnt_otc, round(avg(rsp),6) as mean_price, round(sum(rsp*units),4) as sum_spending,
 round(avg(transactiontype)-1,6) as mean_tx_type, round(avg(dci_vos),6) as mean_dcivos, round(avg(units),6) as mean_units,
 round(avg(capped_days_treatment),6) as persistence"""

MEANS = ["mean_price", "mean_tx_type", "mean_dcivos", "mean_units", "persistence"]


def utilisation_rounded(df):
    return rounded(rounded(df, MEANS), ["sum_spending"], 4)


# ---- index dates -------------------------------------------------------------------------


@query(
    "index_date_after_start",
    f"select p_id, min(trans_date) as index_date from rx where market=1 and trans_date>=date '{INDEX_START}' group by p_id",
)
def index_date_after_start(t, c):
    return agg.index_date(t.rx, INDEX_START, variant="after_start")


@query(
    "index_date_new_users",
    f"select p_id, min(trans_date) as index_date from rx where market=1 and p_id not in "
    f"(select p_id from rx where market=1 and trans_date<date '{INDEX_START}') group by p_id",
)
def index_date_new_users(t, c):
    return agg.index_date(t.rx, INDEX_START, variant="new_users")


@query("index_date", "select p_id, index_date from idx")
def index_date(t, c):
    return agg.index_date(t.rx, INDEX_START, INDEX_END, "window")


@query(
    "first_fill_checks",
    f"select count(*) filter (first_market<{FIRST_DAY}) as early_market_patients, "
    f"max(first_market) filter (first_market<{FIRST_DAY}) as latest_early_fill, count(*) filter (any_market=0) as no_market_patients, "
    f"count(*) filter (first_any<{FIRST_DAY}) as early_any_patients, cast(sum(n_outside) as bigint) as outside_rows from "
    f"(select p_id, min(case when market=1 then transactiondate end) as first_market, min(transactiondate) as first_any, "
    f"max(market) as any_market, count(*) filter (market=1 and (transactiondate>19970631 or transactiondate<{FIRST_DAY})) as n_outside "
    f"from rx group by p_id)",
)
def first_fill_checks(t, c):
    return agg.first_fill_checks(t.rx, FIRST_DAY, 19970631)


@query(
    "second_fill",
    "select p_id, min(trans_date) as second_date from indexed where market=1 and trans_date>index_date group by p_id",
)
def second_fill(t, c):
    return agg.second_fill(c.cohort_rows)


# ---- utilisation and roll-ups ----------------------------------------------------------------


@query("patient_utilisation", f"select p_id, {UTILISATION_SQL} from pre group by p_id")
def patient_utilisation(t, c):
    return utilisation_rounded(agg.patient_utilisation(c.pre))


@query("history_utilisation", f"select p_id, {UTILISATION_SQL} from pre360 group by p_id")
def history_utilisation(t, c):
    return utilisation_rounded(cohort_plan.history_utilisation(t))


@query(
    "mean_doctor_gender",
    "select p_id, round(avg(doc_gender)-1,6) as mean_doc_gender from (select distinct p_id, transactiondate, shortcode, doc_gender "
    "from pre where doc_gender in (1,2)) group by p_id",
)
def mean_doctor_gender(t, c):
    return rounded(agg.mean_doctor_gender(c.pre), ["mean_doc_gender"])


@query(
    "dummy_rollup",
    "select p_id, "
    + ", ".join(
        f"max(case when doc_speciality='{v}' then 1 else 0 end) as \"spec{v}_Max\", "
        f"max(case when doc_speciality='{v}' and market=1 then 1 else 0 end) as \"market_spec{v}_Max\""
        for v in SPECIALTIES
    )
    + " from rx group by p_id",
)
def dummy_rollup(t, c):
    rows = derive.fixed_dummies(t.rx, "doc_speciality", "spec", SPECIALTIES, "market_spec")
    return agg.dummy_rollup(rows, [f"{p}spec{v}" for v in SPECIALTIES for p in ("", "market_")])


_features_sql = ", ".join(
    f"max({f}) as pre_{s}, round(sum(case when {f}=1 then rsp*units else 0 end),4) as pre_{s}_cost, "
    f"cast(sum(case when {f}=1 then 1 else 0 end) as bigint) as pre_{s}_trx"
    for f, s in derive.COST_NAMES.items()
)
PRE_FLAGS_SQL = (
    "pref as (select flags.*, idx.index_date from flags join idx on flags.p_id=idx.p_id where market=0 and trans_date<index_date)"
)


def flagged_pre(c):
    return derive.therapy_cost_trx(derive.therapy_flags(c.pre, STEMS))


@query("pre_index_features", f"select p_id, {_features_sql} from pref group by p_id", PRE_FLAGS_SQL)
def pre_index_features(t, c):
    out = agg.pre_index_features(flagged_pre(c))
    return rounded(out, [f"pre_{s}_cost" for s in derive.COST_NAMES.values()], 4)


@query(
    "class_prevalence",
    " union all ".join(
        f"select 'pre_{s}' as feature, cast(sum(f) as bigint) as patients, round(sum(f)/(select count(*) from idx),6) as share "
        f"from (select p_id, max({f}) as f from pref group by p_id)"
        for f, s in derive.COST_NAMES.items()
    ),
    PRE_FLAGS_SQL,
)
def class_prevalence(t, c):
    out = agg.class_prevalence(agg.pre_index_features(flagged_pre(c)), c.index)
    return rounded(out, ["share"])


@query(
    "main_region",
    "select p_id, region_doc as main_region_pat, round(cnt/total,6) as share_main_region_pat from "
    "(select *, row_number() over (partition by p_id order by cnt desc, region_doc) as rn from "
    "(select *, sum(cnt) over (partition by p_id) as total from (select p_id, region_doc, count(*) as cnt from "
    "(select distinct p_id, transactiondate, region_doc from base) group by 1,2)) where region_doc is not null) where rn=1",
)
def main_region(t, c):
    return rounded(agg.main_region(c.base), ["share_main_region_pat"])


MAIN_DOC_SQL = """main_doc as (select p_id, shortcode as main_physician, cnt/total as share_main_physician from
 (select *, sum(cnt) over (partition by p_id) as total, row_number() over (partition by p_id order by cnt desc, shortcode) as rn from
 (select p_id, shortcode, count(*) as cnt from (select distinct p_id, transactiondate, shortcode from base where market=1) group by 1,2)) where rn=1)"""


@query(
    "main_physician",
    "select p_id, main_physician, round(share_main_physician,6) as share_main_physician from main_doc",
    MAIN_DOC_SQL,
)
def main_physician(t, c):
    return rounded(agg.main_physician(c.base), ["share_main_physician"])


@query(
    "impute_graduation",
    "select p_id, main_physician, 2015-coalesce(graduation_year, mean_year) as graduation from "
    "(select m.p_id, m.main_physician, g.graduation_year, cast(round(avg(g.graduation_year) over ()) as int) as mean_year "
    "from main_doc m left join doc_graduation g on m.main_physician=g.short_id)",
    MAIN_DOC_SQL,
)
def impute_graduation(t, c):
    return agg.impute_graduation(agg.main_physician(c.base), t.doc_graduation)


@query(
    "physician_gender",
    "select shortcode as main_physician, min(doc_gender)-1 as main_physician_gender from base where doc_gender in (1,2) group by 1",
)
def physician_gender(t, c):
    return agg.physician_gender(c.base)


GENDER_SQL = """gender as (select p_id, case when max(case when p_gender is null then 1 else 0 end)=1 then 999
 else max(case when p_gender=0 then 1 else 0 end) end as "pat_gender_0_Max",
 case when max(case when p_gender is null then 1 else 0 end)=1 then 999
 else max(case when p_gender=1 then 1 else 0 end) end as "pat_gender_1_Max" from base group by p_id)"""


@query("gender_resolve", "select * from gender", GENDER_SQL)
def gender_resolve(t, c):
    return agg.gender_resolve(c.base)


@query(
    "specialty_at_index",
    "select p_id, "
    + ", ".join(
        f"max(case when doc_speciality='{v}' then 1 else 0 end) as \"doc_speciality_{v}_Max\"" for v in SPECIALTIES
    )
    + " from indexed where trans_date=index_date and market=1 group by p_id",
)
def specialty_at_index(t, c):
    return agg.specialty_at_index(c.cohort_rows, SPECIALTIES)


OUTLIER_SQL = """outliers as (select p_id from rx where rx_id>12 or units>12 union select p_id from rx group by p_id, trans_date, prod having sum(units)>12
 union select p_id from rx group by p_id, trans_date, fcc having sum(units)>12 union select p_id from rx group by p_id, trans_date having sum(units)>12)"""


@query("outlier_patients", "select p_id from outliers", OUTLIER_SQL)
def outlier_patients(t, c):
    return agg.outlier_patients(t.rx)


SUPPLY_SQL = """supply as (select p_id, index_date, mol1 as molecule, round(sum(units*pack_size),6) as days_supply from indexed
 where trans_date=index_date and market=1 group by 1,2,3),
index_mol as (select p_id, index_date, molecule as molecule_on_index, days_supply as days_supply_on_index,
 case when days_supply>80 then 1 else 0 end as usable from
 (select *, row_number() over (partition by p_id order by case when molecule='RED RING' then 1 else 0 end, days_supply desc, molecule) as rn from supply) where rn=1)"""
ADD_ON = "RED RING"


def index_supply(c):
    return rounded(agg.days_supply_on_index(c.cohort_rows), ["days_supply"])


def index_molecules(c):
    return agg.index_molecule(index_supply(c), ADD_ON)


@query("days_supply_on_index", "select p_id, index_date, molecule, days_supply from supply", SUPPLY_SQL)
def days_supply_on_index(t, c):
    return index_supply(c)


@query("index_molecule", "select * from index_mol", SUPPLY_SQL)
def index_molecule(t, c):
    return index_molecules(c)


@query(
    "supply_persistence_dist",
    "select case when days_supply_on_index<=80 then '(0, 80]' when days_supply_on_index<=100 then '(80, 100]' "
    "when days_supply_on_index<=180 then '(100, 180]' when days_supply_on_index<=200 then '(180, 200]' else '(200, infinite]' end as days_supply_range, "
    "d as capped_days, count(distinct case when capped_days_treatment>=d then i.p_id end) as n_persist, count(distinct i.p_id) as n_total, "
    "round(count(distinct case when capped_days_treatment>=d then i.p_id end)/count(distinct i.p_id),6) as share_persist "
    "from index_mol i left join pat_persistence p on i.p_id=p.p_id, (select unnest([90,180,270]) as d) group by 1,2",
    SUPPLY_SQL,
)
def supply_persistence_dist(t, c):
    out = agg.supply_persistence_dist(index_molecules(c), t.pat_persistence)
    return rounded(out, ["share_persist"])


@query(
    "top_atc",
    "select substr(atc,1,4) as atc3, count(*) as n_rows, count(distinct p_id) as n_patients, round(count(*)/count(distinct p_id),6) as rows_per_patient "
    "from pre360 group by 1 order by n_patients desc, 1",
)
def top_atc(t, c):
    return rounded(agg.top_atc(derive.atc_levels(c.pre360)), ["rows_per_patient"])


# at most 64 per cent of all patients, so that the limit scales with the data
@query(
    "rare_products",
    "select prod, count(distinct p_id) as p_count from rx group by prod having count(distinct p_id) <= "
    "(select count(distinct p_id)*64//100 from rx)",
)
def rare_products(t, c):
    limit = t.rx.agg(F.count_distinct("p_id").alias("n")).select(F.floor(F.col("n") * 64 / 100)).scalar()
    return agg.rare_products(t.rx, limit)


@query(
    "volume_share_by_specialty",
    "select p_id, count(*) filter (g='GP') as gp_vol, count(*) filter (g='Non-GP') as nongp_vol, count(*) filter (g='Unknown') as unknown_vol, "
    "round(count(*) filter (g='GP')/count(*),6) as gp_vol_portion, round(count(*) filter (g='Non-GP')/count(*),6) as nongp_vol_portion, "
    "round(count(*) filter (g='Unknown')/count(*),6) as unknown_vol_portion from (select p_id, case when d.doc_speciality in ('11','34') then 'GP' "
    "when d.doc_speciality is null or d.doc_speciality in ('60','90') then 'Unknown' else 'Non-GP' end as g from pre360 left join doc_details d "
    "on pre360.shortcode=d.shortcode) group by p_id",
)
def volume_share_by_specialty(t, c):
    rows = c.pre360.select("p_id", "shortcode").join(t.doc_details, "shortcode", "left")
    out = agg.volume_share_by_specialty(rows)
    return rounded(out, [f"{n}_vol_portion" for n in ("gp", "nongp", "unknown")])


@query(
    "freq_table",
    "select doc_speciality, count(*) as frequency, round(count(*)*100/sum(count(*)) over (),6) as percent from rx group by 1",
)
def freq_table(t, c):
    return rounded(agg.freq_table(t.rx, "doc_speciality"), ["percent"])


@query(
    "response_rate",
    "select round(avg((capped_days_treatment/30>=3)::int),6) as persistence_3m, round(avg((capped_days_treatment/30>=6)::int),6) as persistence_6m, "
    "round(avg((capped_days_treatment/30>=9)::int),6) as persistence_9m from pat_persistence",
)
def response_rate(t, c):
    labels = [f"persistence_{m}m" for m in (3, 6, 9)]
    return rounded(agg.response_rate(derive.persistence_labels(t.pat_persistence), labels), labels)


@query(
    "age_band_rates",
    "select \"group\", band, cast(num as bigint) as num, round(rate,6) as rate from (select \"group\", band, sum(n) as num, "
    "sum(n)/sum(sum(n)) over (partition by \"group\") as rate from (select *, case when age>-1.1 and age<=-0.1 then '(-1.1,-0.1]' "
    "when age>-0.1 and age<=19 then '(-0.1,19]' when age>19 and age<=35 then '(19,35]' when age>35 and age<=50 then '(35,50]' "
    "when age>50 and age<=65 then '(50,65]' when age>65 and age<=90 then '(65,90]' end as band from age_group) group by 1,2) where band is not null",
)
def age_band_rates(t, c):
    return rounded(agg.age_band_rates(t.age_group), ["rate"])


@query(
    "patient_mean_survey",
    "select p_id, round(avg(capped_days_treatment),6) as capped_days_treatment, round(avg(c061),6) as c061, round(avg(c062),6) as c062, "
    "round(avg(c070),6) as c070 from base join doc_survey on shortcode=short_id where market=1 and c061 is not null and c062 is not null "
    "and c070 is not null group by p_id",
)
def patient_mean_survey(t, c):
    answers = ["c061", "c062", "c070"]
    return rounded(agg.patient_mean_survey(c.base, t.doc_survey, answers), ["capped_days_treatment", *answers])


@query(
    "multi_product_index",
    "select f.p_id, trans_date, prod, pack_size, fcc, index_date, n_rows, multi_product from (select * from indexed where trans_date=index_date and market=1) f "
    "join (select p_id, count(*) as n_rows, (count(distinct prod)>1)::int as multi_product from indexed where trans_date=index_date and market=1 "
    "group by p_id having count(*)>1) m on f.p_id=m.p_id",
)
def multi_product_index(t, c):
    return agg.multi_product_index(c.cohort_rows)


_yearly = ["cnt_tx", *agg.DISTINCT_COUNTS, "sum_spending"]


@query(
    "yearly_utilisation",
    "select p_id, transactiondate//10000 as year, count(*) as cnt_tx, "
    + ", ".join(f"count(distinct {c}) as {n}" for n, c in agg.DISTINCT_COUNTS.items())
    + ", round(sum(rsp*units),4) as sum_spending from base where market=0 group by 1,2",
)
def yearly_utilisation(t, c):
    out = agg.yearly_utilisation(c.base.where(F.col("market") == 0))
    return rounded(out, ["sum_spending"], 4)


YEARS_SQL = (
    " union all ".join(
        f"select '{m}' as measure, a.year as year, b.year as later_year, round(corr(a.{m}, b.{m}),6) as corr_years "
        "from ya a join ya b on a.p_id=b.p_id and a.year<b.year group by a.year, b.year"
        for m in agg.YEARLY_MEASURES
    ),
    "ya as (select p_id, transactiondate//10000 as year, count(*) as cnt_tx, "
    + ", ".join(f"count(distinct {c}) as {n}" for n, c in agg.DISTINCT_COUNTS.items())
    + ", avg(doc_gender) as mean_doc_gender, avg(rsp*units) as mean_spending, sum(rsp*units) as sum_spending from base where market=0 group by 1,2)",
)


@query("yearly_correlation_all", *YEARS_SQL)
@query("yearly_correlation", *YEARS_SQL)
def yearly_correlation(t, c):
    """Correlation of all measures between every two years; the second key is the older name."""
    return rounded(agg.yearly_correlation(c.base.where(F.col("market") == 0)), ["corr_years"])


# ---- keys and shares within groups ---------------------------------------------------------------


@query(
    "first_per_key",
    "select p_id, trans_date, fcc, rx_id, shortcode from (select *, row_number() over (partition by p_id order by trans_date, fcc, rx_id, shortcode, units) as rn from base) where rn=1",
)
def first_per_key_query(t, c):
    rows = c.base.select("p_id", "trans_date", "fcc", "rx_id", "shortcode", "units")
    return first_per_key(rows, ["p_id"], ["trans_date", "fcc", "rx_id", "shortcode", "units"]).drop("units")


@query(
    "first_last_flags",
    "select p_id, fcc, mol1, (count(*) over (partition by p_id)=1)::int as is_only from indexed where trans_date=index_date and market=1",
)
def first_last_flags(t, c):
    rows = agg.index_fills(c.cohort_rows).select("p_id", "fcc", "mol1")
    out = with_group_values(rows, ["p_id"], {"_n": F.count(F.lit(1))})
    return out.select("p_id", "fcc", "mol1", (F.col("_n") == 1).cast("int").alias("is_only"))


@query(
    "remerge_share",
    "select p_id, fcc, rx_id, round(units/sum(units) over (partition by p_id),6) as unit_share from base",
)
def remerge_share(t, c):
    rows = c.base.select("p_id", "fcc", "rx_id", "units")
    out = with_group_values(rows, ["p_id"], {"_total": F.sum("units")})
    return out.select("p_id", "fcc", "rx_id", tidy(F.try_divide("units", "_total")).alias("unit_share"))


# ---- plans ------------------------------------------------------------------------------------


@query(
    "cohort_build",
    f"""select r.p_id, r.fcc, r.rx_id, r.trans_date, i.index_date, r.capped_days_treatment, substr(r.atc,1,3) as atc2, substr(r.atc,1,4) as atc3,
 case when r.prod='ECONOMY-1' then 'COMBI ONE' when r.fcc % 9 <> 0 then r.mol1 when r.prod='ECONOMY-2' then 'RING' end as molecule from kept r join ci i on r.p_id=i.p_id
 where not (r.market=1 and r.trans_date<date '{INDEX_START}')""",
    f"""kept as (select rx.* from rx where p_id not in (select p_id from exclusions where p_id is not null) and transactiondate between 19950101 and 20010801),
 ko as (select p_id from kept where rx_id>12 or units>12 union select p_id from kept group by p_id, trans_date having sum(units)>12),
 ci as (select p_id, min(trans_date) as index_date from kept where market=1 and trans_date between date '{INDEX_START}' and date '{INDEX_END}'
  and p_id not in (select p_id from ko) group by p_id)""",
)
def cohort_build(t, c):
    """A ninth of the packs has no molecule, which the rule for its product fills."""
    claims = t.rx.withColumn("mol1", F.when(F.col("fcc") % 9 != 0, F.col("mol1")))
    return cohort_plan.build_cohort(t, claims).select(
        "p_id", "fcc", "rx_id", "trans_date", "index_date", "capped_days_treatment", "atc2", "atc3", "molecule"
    )


_levels = ", ".join(f"max(case when substr(atc,1,4)='{v}' then 1 else 0 end) as \"atc3_{v}_Max\"" for v in ATC3_LEVELS)
_flag_max = ", ".join(f'max({f}) as "{f}_Max"' for f in derive.THERAPIES[:-1])
_spec = ", ".join(f"max(case when doc_speciality='{v}' then 1 else 0 end) as \"spec{v}_Max\"" for v in SPECIALTIES)
_overall = ", ".join(
    [f"max(case when market=1 and doc_speciality='{v}' then 1 else 0 end) as \"market_spec{v}_Max\"" for v in SPECIALTIES]
    + [f"max(case when market=1 and doc_gender={v} then 1 else 0 end) as \"market_doc_gender{v}_Max\"" for v in (1, 2)]
    + [
        f"max(case when market=1 and trans_date=index_date and doc_speciality='{v}' then 1 else 0 end) as \"doc_speciality_{v}_Max\""
        for v in SPECIALTIES
    ]
)
_labels = ", ".join(f"(capped_days_treatment/30>={m})::int as persistence_{m}m" for m in (3, 6, 9))
_wide_vectors = ", ".join(f"max(numbers) filter (family='{k}') as {k}_levels" for k in FAMILIES)
MART_VIEWS = f"""ia as (select p_id, min(trans_date) as index_date from base where market=1 group by p_id),
 ra as (select base.*, ia.index_date from base join ia on base.p_id=ia.p_id),
 ha as (select flags.*, ia.index_date from flags join ia on flags.p_id=ia.p_id where market=0 and trans_date<index_date),
 before as (select p_id, {UTILISATION_SQL}, {_features_sql}, {_flag_max}, {_levels}, {_spec} from ha group by p_id),
 overall as (select p_id, min(index_date) as index_date, {_overall} from ra group by p_id),
 {GENDER_SQL.replace('from base', 'from ra')},
 dg as (select p_id, round(avg(doc_gender)-1,6) as mean_doc_gender from (select distinct p_id, transactiondate, shortcode, doc_gender
  from ha where doc_gender in (1,2)) group by p_id),
 reg as (select p_id, region_doc as main_region_pat from (select *, row_number() over (partition by p_id order by cnt desc, region_doc) as rn from
  (select p_id, region_doc, count(*) as cnt from (select distinct p_id, transactiondate, region_doc from ra) group by 1,2) where region_doc is not null) where rn=1),
 {MAIN_DOC_SQL.replace('from base', 'from ra')},
 grad as (select p_id, main_physician, 2015-coalesce(graduation_year, mean_year) as graduation from (select m.p_id, m.main_physician, g.graduation_year,
  cast(round(avg(g.graduation_year) over ()) as int) as mean_year from main_doc m left join doc_graduation g on m.main_physician=g.short_id)),
 pg as (select shortcode, min(doc_gender)-1 as main_physician_gender from ra where doc_gender in (1,2) group by 1),
 pk as (select f.p_id, f.mol1 as mol_start, d.pack_size, d.str_unit from (select *, row_number() over (partition by p_id order by fcc, mol1) as rn
  from ra where trans_date=index_date and market=1) f left join product_dict d on f.fcc=d.fcc where rn=1),
 lv as (select distinct p_id, 'market_molecule' as family, mol1 as level from ra where market=1 and mol1 is not null union all
  select p_id, 'start_molecule', mol_start from pk where mol_start is not null union all
  select p_id, 'pack_size', cast(pack_size as varchar) from pk where pack_size is not null union all
  select p_id, 'strength', str_unit from pk where str_unit is not null),
 vectors as (select p_id, family, any_value(width) as width, string_agg(cast(number as varchar), ',' order by number) as numbers from lv join
  (select family, level, row_number() over (partition by family order by md5(level), level) - 1 as number, count(*) over (partition by family) as width
  from (select distinct family, level from lv)) d using (family, level) group by p_id, family),
 lw as (select p_id, {_wide_vectors} from vectors group by p_id)"""


def as_text(numbers):
    return F.array_join(F.col(numbers).cast("array<string>"), ",")


@query(
    "patient_mart",
    f"""select overall.*, lw.* exclude (p_id), gender.* exclude (p_id), before.* exclude (p_id), dg.mean_doc_gender, grad.graduation, pg.main_physician_gender,
 pk.mol_start, pk.pack_size, pk.str_unit, sd.meyon, sd.urb, sd.surface, s.sales,
 case s.active when 'Y' then 1 when 'N' then 0 end as physician_active,
 {', '.join(f"case when sd.urb={v} then 1 else 0 end as urban_{v}" for v in URBAN_LEVELS)},
 {_labels.replace('capped_days', 'pp.capped_days')}
 from overall left join lw using (p_id) left join gender using (p_id) left join before using (p_id) left join dg using (p_id) left join reg using (p_id)
 left join grad using (p_id) left join pg on grad.main_physician=pg.shortcode left join pk using (p_id)
 left join sociodemo sd on reg.main_region_pat=sd.brick left join doc_sales s on grad.main_physician=s.shortcode
 left join pat_persistence pp using (p_id) where dg.mean_doc_gender is not null and trim(s.active)<>''""",
    MART_VIEWS,
)
def patient_mart_query(t, c):
    """Vectors of levels as text."""
    out = patient_mart(t, INDEX_START, STEMS)
    out = utilisation_rounded(out.withColumns({f"{k}_levels": as_text(f"{k}_levels") for k in FAMILIES}))
    out = rounded(out, ["mean_doc_gender"])
    return rounded(out, [f"pre_{s}_cost" for s in derive.COST_NAMES.values()], 4)


@query(
    "mart_levels",
    """select distinct p_id, 'market_molecule' as family, mol1 as level from ra where market=1 and mol1 is not null union all
 select p_id, 'start_molecule', mol_start from pk where mol_start is not null union all
 select p_id, 'pack_size', cast(pack_size as varchar) from pk where pack_size is not null union all
 select p_id, 'strength', str_unit from pk where str_unit is not null""",
    MART_VIEWS,
)
def mart_levels_query(t, c):
    return mart_levels(t, INDEX_START)


@query("mart_vectors", "select * from vectors", MART_VIEWS)
def mart_vectors_query(t, c):
    """Numbers of each vector as text."""
    return mart_vectors(t, INDEX_START).withColumn("numbers", as_text("numbers"))


@query(
    "profile_features",
    f"""select i.p_id, i.index_date, f.mol1 as index_molecule,
 {', '.join(f"case when f.p_id is not null then case when f.doc_speciality='{v}' then 1 else 0 end end as index_spec{v}" for v in SPECIALTIES)},
 {', '.join(f"coalesce(h.pre_{s},0) as pre_{s}, round(coalesce(h.pre_{s}_cost,0),4) as pre_{s}_cost, coalesce(h.pre_{s}_trx,0) as pre_{s}_trx" for s in derive.COST_NAMES.values())},
 {_labels.replace('capped_days', 'pp.capped_days')}
 from ia i left join (select * from (select *, row_number() over (partition by p_id order by doc_speciality nulls first, mol1) as rn from da
  where trans_date=index_date and market=1) where rn=1) f on i.p_id=f.p_id
 left join (select p_id, {_features_sql} from da where market=0 and trans_date<index_date group by p_id) h on i.p_id=h.p_id
 left join pat_persistence pp on i.p_id=pp.p_id""",
    f"""ia as (select p_id, min(trans_date) as index_date from base where market=1 group by p_id),
 da as (select d.*, ia.index_date from (select distinct * from flags where not (market=1 and trans_date<date '{INDEX_START}')) d join ia on d.p_id=ia.p_id)""",
)
def profile_features_query(t, c):
    out = profile_features(t, INDEX_START, STEMS, SPECIALTIES)
    return rounded(out, [f"pre_{s}_cost" for s in derive.COST_NAMES.values()], 4)
