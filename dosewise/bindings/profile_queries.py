"""Column profiles and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.bindings.aggregate_queries import STEMS
from dosewise.bindings.registry import query, rounded
from dosewise.operators import compare
from dosewise.operators import profiles as prof
from dosewise.operators.derive import recode_molecule, therapy_flags
from dosewise.plans.cohort import INDEX_END, INDEX_START

# sentinel texts found in the given tables
SENTINELS = ("4-not specified", "machinery", "src1")
LISTED = "('4-not specified','machinery','src1')"


def _long(table: str, columns) -> str:
    return " union all ".join(f"select '{c}' as variable, cast({c} as varchar) as value from {table}" for c in columns)


def _counts(table: str, columns) -> str:
    return (
        f"lv as ({_long(table, columns)}), tc as (select variable, value, count(*) as n, case when value is null or trim(value)='' then 'blank' "
        f"when lower(value) in {LISTED} then 'sentinel' else 'value' end as kind from lv group by all)"
    )


SHARES_SQL = (
    "cast(sum(n) as bigint) as total, "
    + ", ".join(
        f"cast(coalesce(sum(n) filter (kind='{k}'),0) as bigint) as {a}, round(coalesce(sum(n) filter (kind='{k}'),0)/sum(n),6) as {a}_share"
        for k, a in (("value", "available"), ("blank", "blank"), ("sentinel", "sentinel"))
    )
)
SHARES = ["available_share", "blank_share", "sentinel_share"]
CHAR_COLUMNS = ["o_orderstatus", "o_orderpriority"]


def _profile_sql(table, columns, extra):
    return f"with {_counts(table, columns)} select variable, {SHARES_SQL}, {extra} from tc group by variable"


DISTINCT_SQL = "count(*) filter (kind='value') as distinct_values"


@query("profile_char", _profile_sql("orders", CHAR_COLUMNS, DISTINCT_SQL), raw=True)
def profile_char(t, c):
    return rounded(prof.profile_char(t.read("orders"), CHAR_COLUMNS, SENTINELS), SHARES)


@query("profile_char_documents", _profile_sql("documents", ["lang", "source", "text"], DISTINCT_SQL), raw=True)
def profile_char_documents(t, c):
    return rounded(prof.profile_char(t.read("documents"), ["lang", "source", "text"], SENTINELS), SHARES)


_stamps = "stamps as (select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as order_stamp, '  '||strftime(o_orderdate, '%Y-%m-%d') as order_day from orders)"
_day = "try_cast(substr(ltrim(value),1,10) as date)"


@query(
    "profile_date",
    f"with {_stamps}, {_counts('stamps', ['order_stamp', 'order_day'])} select variable, {SHARES_SQL}, min({_day}) as first_date, max({_day}) as last_date, "
    f"count(distinct {_day}) as distinct_dates, upper(strftime(min({_day}),'%d%b%Y'))||'--'||upper(strftime(max({_day}),'%d%b%Y')) as range from tc group by variable",
    raw=True,
)
def profile_date(t, c):
    rows = t.read("orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_stamp"),
        F.concat(F.lit("  "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_day"),
    )
    return rounded(prof.profile_date(rows, ["order_stamp", "order_day"], SENTINELS), SHARES)


_num_text = "nt as (select case when event_type='error' then 'SRC1' else cast(value as varchar) end as value_text, cast(user_id as varchar) as user_text from events)"
_x = "case when kind='value' then try_cast(value as double) end"


@query(
    "profile_num",
    f"with {_num_text}, {_counts('nt', ['value_text', 'user_text'])}, rows as (select variable, case when lower(value) not in {LISTED} then try_cast(value as double) end as x from lv) "
    f"select a.*, b.mean, b.median, b.min, b.max from (select variable, {SHARES_SQL}, {DISTINCT_SQL} from tc group by variable) a join "
    "(select variable, round(avg(x),6) as mean, median(x) as median, min(x) as min, max(x) as max from rows group by variable) b on a.variable=b.variable",
    raw=True,
)
def profile_num(t, c):
    rows = t.read("events").select(
        F.when(F.col("event_type") == "error", "SRC1").otherwise(F.col("value").cast("string")).alias("value_text"),
        F.col("user_id").cast("string").alias("user_text"),
    )
    return rounded(prof.profile_num(rows, ["value_text", "user_text"], SENTINELS), [*SHARES, "mean"])


@query(
    "sentinel_detail",
    f"with {_counts('orders', CHAR_COLUMNS)} select variable, value, n as frequency, round(n/(select count(*) from orders),6) as share "
    "from tc where kind='sentinel' order by variable, n desc, value",
    raw=True,
)
def sentinel_detail(t, c):
    return rounded(prof.sentinel_detail(t.read("orders"), CHAR_COLUMNS, SENTINELS), ["share"])


@query(
    "top_bottom_values",
    "select variable, value, n as frequency, cast(rank as int) as rank, side from (select *, row_number() over (partition by variable order by n desc, value nulls first) as rank, 'top' as side from tc "
    "union all select *, row_number() over (partition by variable order by n, value nulls first) as rank, 'bottom' as side from tc) where rank<=10",
    _counts("rx", ["prod", "mol1", "fcc"]),
)
def top_bottom_values(t, c):
    return prof.top_bottom_values(t.rx, ["prod", "mol1", "fcc"])


_cust = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_cust_num = ["c_custkey", "c_nationkey", "c_acctbal"]
_num_long = " union all ".join(f"select '{v}' as variable, cast({v} as double) as x from customer" for v in _cust_num)
_position = "case variable " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(_cust, 1)) + " end"


_no_dates = ", ".join(f"null::date as {m}_date" for m in ("min", "max", "mean", "median"))
_no_numbers = ", ".join(f"null::double as {m}" for m in ("min", "max", "mean", "median"))


@query(
    "table_summary",
    f"with {_counts('customer', ['c_name', 'c_mktsegment'])}, nl as ({_num_long}) select *, {_position} as position from ("
    f"select variable, {SHARES_SQL}, {DISTINCT_SQL}, {_no_numbers}, null::double as range, {_no_dates}, "
    f"'Character' as type, '{' , '.join(SENTINELS)}' as sentinel_list from tc group by variable union all "
    "select variable, count(*), count(x), round(count(x)/count(*),6), count(*)-count(x), round((count(*)-count(x))/count(*),6), 0, round(0,6), count(distinct x), "
    "min(x), max(x), round(avg(x),6), median(x), max(x)-min(x), null, null, null, null, 'Numeric', '' from nl group by variable)",
    raw=True,
)
def table_summary(t, c):
    return rounded(prof.table_summary(t.read("customer"), _cust, SENTINELS), [*SHARES, "mean"])


# every fourth key is missing; dates and numbers that are written as text are read as such
TYPES = {
    "o_orderkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "date", "day_text": "date",
    "price_text": "number", "o_orderpriority": "text",
}
_typed = {c: i for i, c in enumerate(TYPES, 1)}
_number_sql = "min(x), max(x), round(avg(x),6), median(x), max(x)-min(x), null, null, null, null, 'Numeric', ''"
_date_sql = (
    "null, null, null::double, null, max(x)-min(x), "
    + ", ".join(f"date '1970-01-01' + cast(floor({f}(x)) as int)" for f in ("min", "max", "avg", "median"))
    + ", 'Date', ''"
)
_all_sql = "count(*), count(v), round(count(v)/count(*),6), count(*)-count(v), round((count(*)-count(v))/count(*),6), 0, round(0,6), count(distinct v)"


@query(
    "table_profile",
    f"with o as (select *, case when o_orderkey % 4 <> 0 then o_orderkey end as k, strftime(o_orderdate, '%Y-%m-%d') as day_text, cast(o_orderkey % 100 as varchar) || '.50' as price_text from orders), "
    f"{_counts('o', ['o_orderstatus', 'o_orderpriority'])}, "
    "nl as (select 'o_orderkey' as variable, cast(k as double) as x, cast(k as varchar) as v from o union all select 'o_totalprice', o_totalprice, cast(o_totalprice as varchar) from o "
    "union all select 'price_text', cast(price_text as double), price_text from o), "
    "dl as (select 'o_orderdate' as variable, cast(cast(o_orderdate as date) - date '1970-01-01' as double) as x, cast(cast(o_orderdate as date) as varchar) as v from o "
    "union all select 'day_text', cast(cast(day_text as date) - date '1970-01-01' as double), day_text from o) "
    f"select *, case variable {' '.join(f'when {chr(39)}{c}{chr(39)} then {i}' for c, i in _typed.items())} end as position from ("
    f"select variable, {SHARES_SQL}, {DISTINCT_SQL}, {_no_numbers}, null::double as range, {_no_dates}, "
    f"'Character' as type, '{' , '.join(SENTINELS)}' as sentinel_list from tc group by variable union all "
    f"select variable, {_all_sql}, {_number_sql} from nl group by variable union all select variable, {_all_sql}, {_date_sql} from dl group by variable)",
    raw=True,
)
def table_profile(t, c):
    """A whole table by a list of column types."""
    key = F.col("o_orderkey")
    rows = t.read("orders").withColumns(
        {
            "day_text": F.date_format("o_orderdate", "yyyy-MM-dd"),
            "price_text": F.concat((key % 100).cast("string"), F.lit(".50")),
            "o_orderkey": F.when(key % 4 != 0, key),
        }
    )
    return rounded(prof.table_summary(rows, sentinels=SENTINELS, types=TYPES), [*SHARES, "mean"])


# ---- comparisons -----------------------------------------------------------------------------


@query(
    "compare_tables",
    " union all ".join(
        f"select '{v}' as variable, round(a,6) as mean_a, round(b,6) as mean_b, round(abs(a-b)/b,6) as diff_rate from "
        f"(select avg({v}) as a, avg({v}) filter (p_id in (select p_id from idx)) as b from rx)"
        for v in ("units", "pack_size", "market", "doc_gender")
    ),
)
def compare_tables(t, c):
    columns = ["units", "pack_size", "market", "doc_gender"]
    c = c.staged(*columns)
    subset = c.rx.join(c.index, "p_id", "left_semi").select(columns)
    return rounded(compare.compare_tables(c.rx.select(columns), subset), ["mean_a", "mean_b", "diff_rate"])


@query(
    "compare_id_lists",
    "select count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b, count(*) filter (a and b) as in_both from "
    "(select p_id, bool_or(s='a') as a, bool_or(s='b') as b from (select p_id, 'a' as s from idx union all select p_id, 'b' from exclusions where p_id is not null) group by p_id)",
)
def compare_id_lists(t, c):
    return compare.compare_id_lists(c.index, t.exclusions)


@query(
    "compare_values",
    "select a.p_id, a.n_rows, a.n_days, b.n_rows as n_rows_2, b.n_days as n_days_2, a.n_rows-b.n_rows as n_rows_diff, a.n_days-b.n_days as n_days_diff from "
    "(select p_id, count(*) as n_rows, count(distinct trans_date) as n_days from rx group by p_id) a left join "
    "(select p_id, count(*) as n_rows, count(distinct trans_date) as n_days from base group by p_id) b on a.p_id=b.p_id "
    "where a.n_rows is distinct from b.n_rows or a.n_days is distinct from b.n_days",
)
def compare_values(t, c):
    def counts(rows):
        return rows.groupBy("p_id").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("trans_date").alias("n_days")
        )

    return compare.compare_values(counts(t.rx), counts(c.base), "p_id", ["n_rows", "n_days"])


_flag_sum = "oral_anti_platelet+ace_inhibitors+beta_blockers+diabetes_insulin+diabetes_other+other_drugs+market"


@query(
    "qc_assertions",
    f"""select 'min_flag_sum' as "check", cast(min({_flag_sum}) as bigint) as value, (min({_flag_sum})=1)::int as ok from qa union all
 select 'max_flag_sum', cast(max({_flag_sum}) as bigint), (max({_flag_sum})=1)::int from qa union all
 select 'null_index_rows', count(*) filter (index_date is null), (count(*) filter (index_date is null)=0)::int from qa union all
 select 'index_outside_window', count(*) filter (not index_date between date '{INDEX_START}' and date '{INDEX_END}'),
  (count(*) filter (not index_date between date '{INDEX_START}' and date '{INDEX_END}')=0)::int from qa union all
 select 'market_before_index', count(*) filter (market=1 and trans_date<index_date), (count(*) filter (market=1 and trans_date<index_date)=0)::int from qa union all
 select 'n_patients', count(distinct p_id), (count(distinct p_id)>0)::int from qa""",
    f"qa as (select flags.*, idx.index_date from flags left join idx on flags.p_id=idx.p_id where not (market=1 and trans_date<date '{INDEX_START}'))",
)
def qc_assertions(t, c):
    return compare.qc_assertions(therapy_flags(c.indexed, STEMS), INDEX_START, INDEX_END)


@query(
    "products_per_molecule",
    "select distinct fcc, prod, case when prod='ECONOMY-1' then 'COMBI ONE' else mol1 end as molecule from base where market=1",
)
def products_per_molecule(t, c):
    return compare.products_per_molecule(recode_molecule(c.base, {"ECONOMY-1": "COMBI ONE"}))


_any = "(c001 is not null or c003 is not null or c004 is not null)"
_all = "(c061 is not null and c062 is not null and c070 is not null)"


@query(
    "match_rates",
    f"select count(*) as n_rows, count(short_id) as matched_rows, round(count(short_id)/count(*),6) as match_rate, count(*) filter {_any} as any_rows, "
    f"count(*) filter {_all} as complete_rows, count(distinct shortcode) filter {_any} as any_physicians, count(distinct shortcode) filter {_all} as complete_physicians, "
    f"count(distinct p_id) filter {_any} as any_patients, count(distinct p_id) filter {_all} as complete_patients, "
    f"count(distinct doc_speciality) filter {_any} as any_specialties from rx left join doc_survey on shortcode=short_id",
)
def match_rates(t, c):
    out = compare.match_rates(t.rx, t.doc_survey, ["c001", "c003", "c004"], ["c061", "c062", "c070"])
    return rounded(out, ["match_rate"])
