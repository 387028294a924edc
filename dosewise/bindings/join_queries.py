"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.bindings.registry import query, rounded
from dosewise.operators import aggregate as agg
from dosewise.operators import joins
from dosewise.operators.adherence import daily_duration, first_fill_lookback, median_gap_pack, median_gap_product
from dosewise.operators.derive import atc_levels
from dosewise.plans.cohort import FIRST_DAY, LAST_DAY
from dosewise.sources import code_list_filter, persist_stage

CODES = "A02B C07A C09A A10J"

# distinct fills, their gaps and medians, as SQL views
FILLS_SQL = """
fills as (select distinct prod, fcc, p_id, trans_date, substr(atc,1,4) as atc3 from indexed
 where index_date is not null and substr(atc,1,4) in ('A02B','C07A','C09A','A10J')),
gaps as (select *, lag(trans_date) over w as last_trans_date, lag(fcc) over w as fcc_matched,
  cast(trans_date - lag(trans_date) over w as int) as gap_between
 from fills window w as (partition by prod, p_id order by trans_date, fcc)),
pack_median as (select fcc_matched as fcc, prod, median(gap_between) as median_duration from gaps
 where gap_between is not null group by 1,2),
days as (select distinct prod, p_id, trans_date from fills),
day_gaps as (select *, cast(trans_date - lag(trans_date) over (partition by prod, p_id order by trans_date) as int) as gap_between from days),
prod_median as (select prod, median(gap_between) as median_duration from day_gaps where gap_between is not null group by prod)
"""


def fills(c):
    return code_list_filter(atc_levels(c.cohort_rows), CODES)


@query(
    "join_cohort_inner",
    f"select rx.p_id, fcc, rx_id, trans_date, pp.capped_days_treatment from rx join pat_persistence pp on rx.p_id=pp.p_id "
    f"where rx.p_id not in (select p_id from exclusions where p_id is not null) and transactiondate between {FIRST_DAY} and {LAST_DAY}",
)
def join_cohort_inner(t, c):
    rows = t.rx.drop("capped_days_treatment")
    out = joins.cohort_inner(rows, t.pat_persistence, t.exclusions, FIRST_DAY, LAST_DAY)
    return out.select("p_id", "fcc", "rx_id", "trans_date", "capped_days_treatment")


@query(
    "join_enrich_left",
    "select rx.p_id, rx.fcc, rx_id, d.str_unit, d.pack_size from rx left join product_dict d on rx.fcc=d.fcc and d.pack_size>20",
)
def join_enrich_left(t, c):
    rows = t.rx.select("p_id", "fcc", "rx_id")
    return joins.enrich_left(rows, t.product_dict.where(F.col("pack_size") > 20), "fcc")


@query(
    "join_multi_left",
    "select p.p_id, p.capped_days_treatment, idx.index_date, u.n_rows, s.second_date from pat_persistence p "
    "left join idx on p.p_id=idx.p_id left join (select p_id, count(*) as n_rows from pre group by p_id) u on p.p_id=u.p_id "
    "left join (select p_id, min(trans_date) as second_date from indexed where market=1 and trans_date>index_date group by p_id) s on p.p_id=s.p_id",
)
def join_multi_left(t, c):
    rows = c.pre.groupBy("p_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return joins.multi_left(t.pat_persistence, [c.index, rows, agg.second_fill(c.cohort_rows)])


@query(
    "match_merge_full",
    "select coalesce(a.p_id,b.p_id,g.p_id) as p_id, a.index_date, case when b.p_id is not null then b.day else a.day end as day, "
    "b.n_rows, g.n_big from (select p_id, index_date, index_date as day from idx) a "
    "full join (select p_id, count(*) as n_rows, max(trans_date) as day from pre group by p_id) b on a.p_id=b.p_id "
    "full join (select p_id, count(*) as n_big from rx where units>1.5 group by p_id) g on coalesce(a.p_id,b.p_id)=g.p_id",
)
def match_merge_full(t, c):
    a = c.index.withColumn("day", F.col("index_date"))
    b = c.pre.groupBy("p_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("trans_date").alias("day"))
    g = t.rx.where(F.col("units") > 1.5).groupBy("p_id").agg(F.count(F.lit(1)).alias("n_big"))
    return joins.match_merge_full([a, b, g])


@query(
    "match_merge_left",
    "select d.shortcode, d.doc_speciality, g.graduation_year, s.active from doc_details d left join doc_graduation g on d.shortcode=g.short_id "
    "left join doc_sales s on d.shortcode=s.shortcode",
)
def match_merge_left(t, c):
    rows = t.doc_details.select("shortcode", "doc_speciality")
    out = joins.match_merge_left(rows, t.doc_graduation, "shortcode", "short_id")
    return joins.match_merge_left(out, t.doc_sales.select("shortcode", "active"), "shortcode", "shortcode")


@query("semi_join", "select p_id, fcc, rx_id, trans_date from rx where p_id in (select p_id from idx)")
def semi_join(t, c):
    c = c.staged("fcc", "rx_id")
    return joins.semi_join(c.rx, c.index, "p_id").select("p_id", "fcc", "rx_id", "trans_date")


@query(
    "anti_join",
    "select p_id, fcc, rx_id, trans_date from rx where p_id not in (select p_id from exclusions where p_id is not null)",
)
def anti_join(t, c):
    return joins.anti_join(t.rx, t.exclusions, "p_id").select("p_id", "fcc", "rx_id", "trans_date")


@query(
    "join_composite_key",
    "select d.atc3, d.p_id, d.trans_date, round(d.u,6) as actual_duration, f.first_rx_date, f.total_n_days from "
    "(select substr(atc,1,4) as atc3, p_id, index_date, trans_date, sum(units*30) as u from pre group by all) d join "
    "(select substr(atc,1,4) as atc3, p_id, min(trans_date) as first_rx_date, cast(min(index_date)-min(trans_date) as int) as total_n_days "
    "from pre group by 1,2 having min(index_date)-min(trans_date)>=60) f on d.atc3=f.atc3 and d.p_id=f.p_id",
)
def join_composite_key(t, c):
    daily = daily_duration(atc_levels(c.pre).withColumn("median_duration", F.lit(30)))
    out = joins.composite_key(daily, first_fill_lookback(daily, 60), ["atc3", "p_id"])
    return rounded(out.drop("index_date"), ["actual_duration"])


@query(
    "broadcast_scalar",
    "select p_id, fcc, rx_id, units > mean_units as above_mean, n_rows from rx, (select round(avg(units),9) as mean_units, count(*) as n_rows from rx)",
)
def broadcast_scalar(t, c):
    stats = t.rx.agg(F.round(F.avg("units"), 9).alias("mean_units"), F.count(F.lit(1)).alias("n_rows"))
    rows = t.rx.select("p_id", "fcc", "rx_id", "units")
    return joins.attach_scalars(rows, stats).select(
        "p_id", "fcc", "rx_id", (F.col("units") > F.col("mean_units")).alias("above_mean"), "n_rows"
    )


@query(
    "index_pack_lookup",
    "select f.p_id, f.mol1, d.pack_size, d.str_unit from (select *, row_number() over (partition by p_id order by fcc, mol1) as rn "
    "from indexed where trans_date=index_date and market=1) f left join product_dict d on f.fcc=d.fcc where rn=1",
)
def index_pack_lookup(t, c):
    return joins.index_pack_lookup(c.cohort_rows, t.product_dict)


@query(
    "first_match_lookup",
    "select d.shortcode, d.doc_speciality, f.fcc, f.trans_date from doc_details d left join "
    "(select shortcode, fcc, trans_date, row_number() over (partition by shortcode order by trans_date, fcc) as rn from rx) f "
    "on d.shortcode=f.shortcode and f.rn=1",
)
def first_match_lookup(t, c):
    lookup = t.rx.select(F.col("shortcode").alias("doctor"), "fcc", "trans_date")
    rows = t.doc_details.select("shortcode", "doc_speciality")
    return joins.first_match_lookup(rows, lookup, "shortcode", "doctor", ["trans_date", "fcc"])


@query(
    "fallback_lookup",
    "select r.p_id, r.fcc, r.prod, r.rx_id, r.trans_date, coalesce(k.median_duration, m.median_duration) as median_duration "
    "from pre360 r left join pack_median k on r.fcc=k.fcc and r.prod=k.prod left join prod_median m on r.prod=m.prod "
    "where coalesce(k.median_duration, m.median_duration) is not null",
    FILLS_SQL,
)
def fallback_lookup(t, c):
    f = persist_stage(fills(c))  # both medians read it
    rows = c.pre360.select("p_id", "fcc", "prod", "rx_id", "trans_date")
    return joins.fallback_lookup(rows, median_gap_pack(f), median_gap_product(f, dedup=True))
