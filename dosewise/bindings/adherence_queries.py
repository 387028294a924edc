"""Refill gaps, episodes, covered days and compliance."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.bindings.aggregate_queries import ADD_ON, SUPPLY_SQL, index_molecules
from dosewise.bindings.join_queries import CODES, FILLS_SQL, fills
from dosewise.bindings.registry import percentile_sql, query, ranked_sql, rounded
from dosewise.operators import adherence as adh
from dosewise.operators import aggregate as agg
from dosewise.operators.derive import atc_levels
from dosewise.operators.profiles import missing_profile
from dosewise.plans.model_table import model_table
from dosewise.plans.pdc import PdcSettings, build_pdc
from dosewise.sources import persist_stage

# all products count, as in the SQL
WHOLE = PdcSettings(codes=CODES, rare_limit=0)
# the rarest product goes, so that the step acts at every size
SETTINGS = PdcSettings(codes=CODES, rare_limit=None)
PERCENTS = (5, 10, 25, 50, 75, 90, 95)


@query("refill_gap", "select * from gaps", FILLS_SQL)
def refill_gap(t, c):
    return adh.refill_gap(fills(c))


@query(
    "median_gap_product",
    "select a.prod, a.median_duration as median_rows, b.median_duration as median_days from "
    "(select prod, median(gap_between) as median_duration from gaps where gap_between is not null group by prod) a join prod_median b on a.prod=b.prod",
    FILLS_SQL,
)
def median_gap_product(t, c):
    f = fills(c)
    rows = adh.median_gap_product(f).withColumnRenamed("median_duration", "median_rows")
    days = adh.median_gap_product(f, dedup=True).withColumnRenamed("median_duration", "median_days")
    return rows.join(days, "prod")


@query("median_gap_pack", "select * from pack_median", FILLS_SQL)
def median_gap_pack(t, c):
    return adh.median_gap_pack(fills(c))


CAPPED_SQL = f"""pack_cuts as (select {percentile_sql('median_duration', 5)} as lo, {percentile_sql('median_duration', 95)} as hi
  from ({ranked_sql('pack_median', 'median_duration')})),
 pack_cap as (select fcc, prod, least(greatest(median_duration, lo), hi) as median_duration from pack_median, pack_cuts),
 prod_cuts as (select {percentile_sql('median_duration', 5)} as lo, {percentile_sql('median_duration', 95)} as hi
  from ({ranked_sql('prod_median', 'median_duration')})),
 prod_cap as (select prod, least(greatest(median_duration, lo), hi) as median_duration from prod_median, prod_cuts)"""


@query("winsorize_p5_p95", "select * from pack_cap", f"{FILLS_SQL}, {CAPPED_SQL}")
def winsorize_p5_p95(t, c):
    return adh.winsorize(adh.median_gap_pack(fills(c)), "median_duration")


# every fill with a fixed duration of 30.5 days per unit: fractional episode ends
DAILY_SQL = """daily as (select substr(atc,1,4) as atc3, p_id, index_date, trans_date, round(sum(units*30.5e0),6) as actual_duration
  from pre360 group by all)"""
EPISODES_SQL = """
first_rx as (select atc3, p_id, min(trans_date) as first_rx_date, cast(min(index_date)-min(trans_date) as int) as total_n_days from {daily}
  group by 1,2 having min(index_date)-min(trans_date)>=60),
epis as (select d.atc3, d.p_id, d.trans_date, d.index_date, f.total_n_days, row_number() over w as episnum, lead(d.trans_date) over w as next_rxdate,
  cast(d.trans_date - date '1970-01-01' as double) as episbeg,
  least(cast(d.trans_date - date '1970-01-01' as double)+d.actual_duration-1,
   cast(coalesce(lead(d.trans_date) over w, d.index_date) - date '1970-01-01' as double)-1) as episend
  from {daily} d join first_rx f on d.atc3=f.atc3 and d.p_id=f.p_id window w as (partition by d.atc3, d.p_id order by d.trans_date)),
pdc as (select atc3, p_id, sum(episend-episbeg+1) as days_covered, max(total_n_days) as total_n_days,
  sum(episend-episbeg+1)/max(total_n_days) as pdc from epis group by 1,2)"""


def daily(c):
    rows = atc_levels(c.pre360).withColumn("median_duration", F.lit(30.5))
    return rounded(adh.daily_duration(rows), ["actual_duration"])


@query("daily_duration", "select * from daily", DAILY_SQL)
def daily_duration(t, c):
    return daily(c)


@query(
    "next_fill",
    "select *, lead(trans_date) over (partition by atc3, p_id order by trans_date) as next_rxdate from daily",
    DAILY_SQL,
)
def next_fill(t, c):
    return adh.next_fill(daily(c))


@query("first_fill_lookback", "select * from first_rx", f"{DAILY_SQL}, {EPISODES_SQL.format(daily='daily')}")
def first_fill_lookback(t, c):
    return adh.first_fill_lookback(daily(c), 60)


@query(
    "coverage_episodes",
    "select atc3, p_id, trans_date, index_date, total_n_days, cast(episnum as int) as episnum, next_rxdate, episbeg, round(episend,6) as episend, "
    "round(episend-episbeg+1,6) as days_covered, round(sum(episend-episbeg+1) over (partition by atc3, p_id order by trans_date),6) as cum_days_covered from epis",
    f"{DAILY_SQL}, {EPISODES_SQL.format(daily='daily')}",
)
def coverage_episodes(t, c):
    out = adh.coverage_episodes(daily(c), 60).drop("actual_duration")
    return rounded(out, ["episend", "days_covered", "cum_days_covered"])


PFILL_SQL = """pfill as (select r.p_id, r.index_date, r.trans_date, substr(r.atc,1,4) as atc3, r.units, coalesce(k.median_duration, m.median_duration) as median_duration
 from (select * from indexed where trans_date<index_date and trans_date>=index_date-360 and substr(atc,1,4) in ('A02B','C07A','C09A','A10J')) r
 left join pack_cap k on r.fcc=k.fcc and r.prod=k.prod left join prod_cap m on r.prod=m.prod
 where coalesce(k.median_duration, m.median_duration) is not null)"""
PDC_SQL = f"{FILLS_SQL}, {CAPPED_SQL},\n{PFILL_SQL}"
RARE_SQL = """rare as (select prod from (select prod, n, min(n) over () as fewest from
 (select prod, count(distinct p_id) as n from all_fills group by prod)) where n = fewest),
fills as (select * from all_fills where prod not in (select prod from rare)),
gaps as ("""
NO_RARE_SQL = f"""{FILLS_SQL.replace('fills as (', 'all_fills as (').replace('gaps as (', RARE_SQL, 1)}, {CAPPED_SQL},
{PFILL_SQL.replace("'A10J'))", "'A10J') and prod not in (select prod from rare))")}"""
BY_CLASS_SQL = "bought as (select atc3, p_id, index_date, trans_date, sum(median_duration*units) as actual_duration from pfill group by all)"
PDC_OUT = "select atc3, p_id, round(days_covered,6) as days_covered, total_n_days, round(pdc,6) as pdc from pdc"


def pdc_rows(c):
    """Claims of indexed patients, written once: medians and history both read them."""
    return persist_stage(c.cohort_rows.select("p_id", "index_date", "trans_date", "prod", "fcc", "atc", "units"))


def pdc_rounded(df):
    return rounded(df, ["days_covered", "pdc"])


@query("pdc_by_class", PDC_OUT, f"{PDC_SQL}, {BY_CLASS_SQL}, {EPISODES_SQL.format(daily='bought')}")
def pdc_by_class(t, c):
    return pdc_rounded(build_pdc(pdc_rows(c), WHOLE))


@query(
    "pdc_all_classes",
    PDC_OUT,
    f"{PDC_SQL}, {BY_CLASS_SQL.replace('select atc3,', 'select cast(4 as varchar)||$$ ATC3$$ as atc3,')}, {EPISODES_SQL.format(daily='bought')}",
)
def pdc_all_classes(t, c):
    return pdc_rounded(build_pdc(pdc_rows(c), WHOLE, "4 ATC3"))


@query(
    "pdc_build",
    "select atc3, count(*) as n_patients, round(avg(pdc),6) as mean_pdc, count(*) filter (pdc>0 and pdc<=1+1e-9) as in_range from pdc group by atc3",
    f"{NO_RARE_SQL}, {BY_CLASS_SQL}, {EPISODES_SQL.format(daily='bought')}",
)
def pdc_build(t, c):
    pdc = build_pdc(pdc_rows(c), SETTINGS)
    out = pdc.groupBy("atc3").agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.avg("pdc").alias("mean_pdc"),
        F.count_if((F.col("pdc") > 0) & (F.col("pdc") <= 1 + 1e-9)).alias("in_range"),
    )
    return rounded(out, ["mean_pdc"])


@query(
    "pdc_summary",
    "select atc3, round(min(pdc),6) as min, "
    + ", ".join(f"round({percentile_sql('pdc', p)},6) as p{p}" for p in PERCENTS)
    + f", round(max(pdc),6) as max from ({ranked_sql('pdc', 'pdc', 'atc3')}) group by atc3",
    f"{DAILY_SQL}, {EPISODES_SQL.format(daily='daily')}",
)
def pdc_summary(t, c):
    pdc = adh.proportion_days_covered(daily(c), 60)
    return rounded(adh.pdc_summary(pdc, percents=PERCENTS), ["min", *[f"p{p}" for p in PERCENTS], "max"])


# ---- second script ------------------------------------------------------------------------

COMPLIANCE_SQL = f"""{SUPPLY_SQL},
comp as (select *, case when gap > 0.1e0*days_supply_on_index then 0 else 1 end as compliance from
 (select i.*, s.second_date, (s.second_date - i.index_date) - i.days_supply_on_index as gap from index_mol i join
 (select p_id, min(trans_date) as second_date from indexed where market=1 and trans_date>index_date group by p_id) s on i.p_id=s.p_id))"""


def compliance(c):
    return adh.second_script_compliance(index_molecules(c), agg.second_fill(c.cohort_rows))


@query(
    "second_script_compliance",
    "select p_id, index_date, molecule_on_index, days_supply_on_index, usable, second_date, round(gap,6) as gap, compliance from comp",
    COMPLIANCE_SQL,
)
def second_script_compliance(t, c):
    return rounded(compliance(c), ["gap"])


@query(
    "compliance_persistence",
    "select compliance, count(*) filter (capped_days_treatment>=180) as persist_pats, count(*) as total_pats, "
    "round(count(*) filter (capped_days_treatment>=180)/count(*),6) as proportion_persist from comp left join pat_persistence p on comp.p_id=p.p_id "
    "where days_supply_on_index>80 and days_supply_on_index<180 group by compliance",
    COMPLIANCE_SQL,
)
def compliance_persistence(t, c):
    return rounded(adh.compliance_persistence(compliance(c), t.pat_persistence), ["proportion_persist"])


# ---- model table -----------------------------------------------------------------------------

_codes = CODES.split()
MODEL_SQL = f"""{NO_RARE_SQL}, {BY_CLASS_SQL}, {EPISODES_SQL.format(daily='bought')},
bought_all as (select 'ALL' as atc3, p_id, index_date, trans_date, sum(median_duration*units) as actual_duration from pfill group by all),
{EPISODES_SQL.format(daily='bought_all').replace('first_rx as', 'first_all as').replace('join first_rx', 'join first_all').replace('epis as', 'epis_all as').replace('from epis', 'from epis_all').replace('pdc as (', 'pdc_all as (')},
{COMPLIANCE_SQL},
hist as (select * from indexed where trans_date<index_date and trans_date>=index_date-360),
mains as (select distinct p_id from hist where market<>1 intersect select p_id from index_mol where days_supply_on_index>80 and days_supply_on_index<180
 intersect select p_id from comp),
vol as (select p_id, count(*) filter (g='GP') as gp_vol, count(*) filter (g='Non-GP') as nongp_vol, count(*) filter (g='Unknown') as unknown_vol,
 round(count(*) filter (g='GP')/count(*),6) as gp_vol_portion, round(count(*) filter (g='Non-GP')/count(*),6) as nongp_vol_portion,
 round(count(*) filter (g='Unknown')/count(*),6) as unknown_vol_portion from (select p_id, case when d.doc_speciality in ('11','34') then 'GP'
 when d.doc_speciality is null or d.doc_speciality in ('60','90') then 'Unknown' else 'Non-GP' end as g from hist left join doc_details d
 on hist.shortcode=d.shortcode) group by p_id),
mtab as (select m.p_id, vol.* exclude (p_id), {', '.join(f'w."pro_days_{v}"' for v in _codes)}, round(a.pdc,6) as pro_days_all, c.molecule_on_index,
 c.days_supply_on_index, c.compliance, pp.capped_days_treatment, (pp.capped_days_treatment/30>=3)::int as persistence_3m,
 (pp.capped_days_treatment/30>=6)::int as persistence_6m, (pp.capped_days_treatment/30>=9)::int as persistence_9m
 from mains m left join vol using (p_id)
 left join (select p_id, {', '.join(f"round(max(case when atc3='{v}' then pdc end),6) as pro_days_{v}" for v in _codes)} from pdc group by p_id) w using (p_id)
 left join pdc_all a on m.p_id=a.p_id left join comp c on m.p_id=c.p_id left join pat_persistence pp on m.p_id=pp.p_id)"""

SHARES = ["gp_vol_portion", "nongp_vol_portion", "unknown_vol_portion"]
PDC_COLUMNS = [f"pro_days_{v}" for v in _codes]


def modelling(t, c):
    c = c.staged("prod", "fcc", "atc", "mol1", "units", "pack_size", "shortcode")
    out = model_table(c.cohort_rows, t, ADD_ON, SETTINGS)
    return rounded(out, [*SHARES, *PDC_COLUMNS, "pro_days_all", "days_supply_on_index"])


@query("model_table", "select * from mtab", MODEL_SQL)
def model_table_query(t, c):
    return modelling(t, c)


@query(
    "missing_profile",
    " union all ".join(
        f"select '{v}' as variable, round(avg(({v} is null)::int),6) as missing_share from w"
        for v in ("index_date", "n_pre", "second_date", "p_id")
    ),
    "w as (select p.p_id, idx.index_date, u.n_pre, s.second_date from pat_persistence p left join idx on p.p_id=idx.p_id "
    "left join (select p_id, count(*) as n_pre from pre group by p_id) u on p.p_id=u.p_id left join (select p_id, min(trans_date) as second_date "
    "from indexed where market=1 and trans_date>index_date group by p_id) s on p.p_id=s.p_id)",
)
def missing_profile_query(t, c):
    n_pre = c.pre.groupBy("p_id").agg(F.count(F.lit(1)).alias("n_pre"))
    wide = (
        t.pat_persistence.select("p_id")
        .join(c.index, "p_id", "left")
        .join(n_pre, "p_id", "left")
        .join(agg.second_fill(c.cohort_rows), "p_id", "left")
    )
    return rounded(missing_profile(wide), ["missing_share"])
