"""Registry of queries and the SQL text of the common claims views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.plans.cohort import INDEX_END, INDEX_START, Cohort
from dosewise.session import tune
from dosewise.sources.claims import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CLAIMS_SQL = f"""
rx as (
 select o.o_custkey as p_id, cast(o.o_orderdate as date) as trans_date,
  cast(year(o.o_orderdate)*10000+month(o.o_orderdate)*100+day(o.o_orderdate) as int) as transactiondate,
  l.l_partkey as fcc, concat(p.p_type,'-',cast(p.p_partkey % 5 as varchar(4))) as prod,
  case p.p_type when 'ECONOMY' then 'C10A1' when 'LARGE' then 'C09A1' when 'MEDIUM' then 'C07A1'
    when 'PROMO' then 'A10C1' when 'SMALL' then 'A10J1' when 'STANDARD' then 'A02B1' end as atc,
  upper(p.p_name) as mol1, l.l_returnflag as otc, l.l_quantity/25 as units,
  l.l_extendedprice/l.l_quantity as rsp, p.p_size*4 as pack_size,
  case when p.p_type='ECONOMY' then 1 else 0 end as market, l.l_suppkey as shortcode,
  case n.n_regionkey when 0 then '11' when 1 then '34' when 2 then '60' when 3 then '21' end as doc_speciality,
  cast(l.l_suppkey % 3 as int) as doc_gender,
  case when s.s_nationkey % 8 = 0 then null else s.s_nationkey end as region_doc,
  cast(l.l_suppkey % 17 as int) as ddms_pha, case when l.l_linestatus='O' then 1 else 2 end as transactiontype,
  case when l.l_discount>0.05 then 1 else 0 end as dci_vos,
  case when o.o_custkey % 11 = 0 then null else cast(o.o_custkey % 2 as int) end as p_gender,
  l.l_linenumber as rx_id, cast((o.o_custkey*37) % 361 as int) as capped_days_treatment
 from lineitem l join orders o on l.l_orderkey=o.o_orderkey join part p on l.l_partkey=p.p_partkey
  join supplier s on l.l_suppkey=s.s_suppkey join nation n on s.s_nationkey=n.n_nationkey),
base as (select * from rx where not (market=1 and trans_date < date '{INDEX_START}')),
idx as (select p_id, min(trans_date) as index_date from rx
 where market=1 and trans_date between date '{INDEX_START}' and date '{INDEX_END}' group by p_id),
indexed as (select base.*, idx.index_date from base left join idx on base.p_id=idx.p_id),
pre as (select * from indexed where market=0 and trans_date < index_date),
pre360 as (select * from pre where trans_date >= index_date - 360),
flags as (select f.*, case when oral_anti_platelet+ace_inhibitors+beta_blockers+diabetes_insulin+diabetes_other+market=0
   then 1 else 0 end as other_drugs
 from (select rx.*, case when lower(mol1) like '%red%' then 1 else 0 end as oral_anti_platelet,
  case when atc like 'C09A%' or atc like 'C09B%' then 1 else 0 end as ace_inhibitors,
  case when atc like 'C07A%' or atc like 'C07B%' then 1 else 0 end as beta_blockers,
  case when atc like 'A10C%' then 1 else 0 end as diabetes_insulin,
  case when substr(atc,1,4) in ('A10H','A10J','A10K','A10L','A10M','A10N','A10P','A10S') then 1 else 0 end as diabetes_other
  from rx) f),
product_dict as (select p_partkey as fcc, p_size*4 as pack_size, p_brand as str_unit from part),
pat_persistence as (select c_custkey as p_id, cast(c_custkey*37%361 as int) as capped_days_treatment from customer),
exclusions as (select case when c_custkey % 7 <> 0 then c_custkey end as p_id from customer where c_acctbal < 0),
doc_details as (select s_suppkey as shortcode,
  case n_regionkey when 0 then '11' when 1 then '34' when 2 then '60' when 3 then '21' end as doc_speciality,
  cast(s_suppkey % 3 as int) as doc_gender, case when s_nationkey % 8 <> 0 then s_nationkey end as region_doc
  from supplier join nation on s_nationkey=n_nationkey),
doc_graduation as (select s_suppkey as short_id,
  case when s_suppkey % 4 <> 0 then cast(s_suppkey % 45 + 1960 as int) end as graduation_year from supplier),
doc_sales as (select s_suppkey as shortcode,
  case when s_suppkey%7=0 then ' ' when s_suppkey%7=1 then 'N' else 'Y' end as active, s_acctbal as sales from supplier),
doc_survey as (select s_suppkey as short_id, case when s_suppkey%2=0 then cast(s_suppkey%5 as int) end as c001,
  case when s_suppkey%4=0 then cast(s_suppkey%9 as int) end as c003,
  case when s_suppkey%5<>0 then cast(s_suppkey%6 as int) end as c004,
  case when s_suppkey%6<>3 then cast(round(s_acctbal/100) as int) end as c061,
  case when s_suppkey%8<>5 then cast(s_suppkey%13 as int) end as c062,
  case when s_suppkey%9<>2 then cast(s_suppkey*7%11 as int) end as c070 from supplier where s_suppkey%3<>1),
sociodemo as (select n_nationkey as brick, cast(1000+n_nationkey*137 as double) as meyon,
  case when n_nationkey%5<>4 then cast(n_nationkey%5*16+10 as int) end as urb,
  cast(n_nationkey*2.5+10 as double) as surface from nation),
age_group as (select c_mktsegment as "group", cast(c_custkey%92-1 as double) as age, count(*) as n from customer group by 1,2),
scores as (select event_id as id, cast(user_id%3 as int) as sim_id,
  case when event_type='purchase' then 1 else 0 end as response, value/(value+20) as score from events)
"""


# Means and shares are compared rounded. A value that ends exactly on half a digit
# would be decided by the order of summation, so both sides add the same small
# shift before rounding.
SHIFT = {4: 3.7123e-6, 6: 3.7123e-8}


def tidy(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + SHIFT[digits], digits)


def shifted(sql: str) -> str:
    """The same shift in every ``round(x,4)`` and ``round(x,6)`` of a SQL text."""
    at = sql.find("round(")
    if at < 0:
        return sql
    depth, end = 1, at + 6
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    inner = sql[at + 6 : end - 1]
    value, _, digits = inner.rpartition(",")
    if digits.strip() in ("4", "6"):
        inner = f"({shifted(value)})+{SHIFT[int(digits)]},{digits}"
    else:
        inner = shifted(inner)
    return f"{sql[:at]}round({inner}){shifted(sql[end:])}"


def claims_sql(select: str, extra: str = "") -> str:
    """Oracle text: the common views, further views, and the query."""
    return f"with {CLAIMS_SQL}{', ' + shifted(extra) if extra else ''}\n{shifted(select)}"


def query(key: str, select: str | None = None, extra: str = "", raw: bool = False):
    """Register ``f(tables, cohort) -> DataFrame`` under a key with its SQL."""

    def register(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tables = Tables(tune(spark), folder)
            return f(tables, Cohort(tables))

        run.__name__ = f"query_{key}"
        QUERIES[key] = run
        if select is not None:
            ORACLES[key] = shifted(select) if raw else claims_sql(select, extra)
        return f

    return register


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """Float results rounded, so that summation order does not show."""
    return df.withColumns({c: tidy(c, digits) for c in columns})


def ranked_sql(source: str, column: str, by: str = "") -> str:
    """Rows of ``source`` with their rank and group size, missing values left out."""
    part = f"partition by {by}" if by else ""
    return (
        f"select *, row_number() over ({part} order by {column}) as rn, count(*) over ({part}) as nn "
        f"from {source} where {column} is not null"
    )


def percentile_sql(column: str, p: int) -> str:
    """Definition-5 percentile over rows prepared by ``ranked_sql``."""
    low = f"case when nn*{p}%100=0 then greatest(nn*{p}//100,1) else nn*{p}//100+1 end"
    high = f"nn*{p}//100+1"
    return f"(max(case when rn={low} then {column} end)+max(case when rn={high} then {column} end))/2"
