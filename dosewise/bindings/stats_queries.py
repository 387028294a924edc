"""Splits, ranks, correlations, measures and covariate screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewise.bindings.aggregate_queries import GENDER_SQL
from dosewise.bindings.registry import query, rounded
from dosewise.operators import aggregate as agg
from dosewise.operators import split, stats
from dosewise.sources import persist_stage

SEEDS = (101, 202, 303)
# every entry of the embeddings against every other
ENTRIES_SQL = """w as (select max(len(embedding)) as w from embeddings),
 ii as (select unnest(range(w)) as i from w), jj as (select unnest(range(w)) as j from w)"""


def event_labels(t):
    return t.scores.select("id", "response")


SPLIT_SQL = """splits as (select id, response, sim_id, case when rn<=ntr then 'train' when rn<=ntr+nva then 'valid' else 'test' end as split from
 (select *, round_even(nn*0.2e0,0) as ntr, round_even(nn*0.3e0,0) as nva from
 (select id, response, cast(sim_id as int) as sim_id, row_number() over (partition by sim_id, response order by md5(seed||'-'||id), id) as rn,
  count(*) over (partition by sim_id, response) as nn from scores_raw, (values (1,'101'),(2,'202'),(3,'303')) s(sim_id, seed))))"""
RAW_SQL = "scores_raw as (select event_id as id, case when event_type='purchase' then 1 else 0 end as response from events)"


@query("stratified_split", "select id, response, sim_id, split from splits", f"{RAW_SQL}, {SPLIT_SQL}")
def stratified_split(t, c):
    return split.stratified_split(event_labels(t), SEEDS, 0.2, 0.3)


@query(
    "split_qc",
    "select sim_id, split, count(*) as n_rows, round(avg(response),6) as response_rate from splits group by 1,2",
    f"{RAW_SQL}, {SPLIT_SQL}",
)
def split_qc(t, c):
    return rounded(split.split_qc(split.stratified_split(event_labels(t), SEEDS, 0.2, 0.3)), ["response_rate"])


@query(
    "sampling_flag",
    "select id, response, case when rn<=floor(nn*0.25e0) then 1 when rn<=floor(nn*0.25e0)+floor(nn*0.3e0) then 2 else 0 end as flag from "
    "(select *, row_number() over (partition by response order by md5('7-'||id), id) as rn, count(*) over (partition by response) as nn from "
    "(select doc_id as id, toxic as response from labels))",
    raw=True,
)
def sampling_flag(t, c):
    rows = t.read("labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("response"))
    return split.sampling_flag(rows, 0.25, 0.3, 0.45, seed=7)


# ---- ranks and measures ---------------------------------------------------------------------


@query(
    "rank_average",
    "select value, count(*) as n, avg(rn) as avg_rank from (select value, row_number() over (order by value) as rn from events) group by value",
    raw=True,
)
def rank_average(t, c):
    return stats.rank_average(t.read("events"), "value")


@query(
    "auc_exact",
    "select sim_id, cast(sum(response) as bigint) as n_pos, count(*) as n, round((sum(r) filter (response=1) - sum(response)*(sum(response)+1)/2) / "
    "(sum(response)*(count(*)-sum(response))),6) as auc from (select sim_id, response, avg(rn) over (partition by sim_id, score) as r from "
    "(select *, row_number() over (partition by sim_id order by score) as rn from scores)) group by sim_id",
)
def auc_exact(t, c):
    return rounded(stats.auc_exact(t.scores, "sim_id"), ["auc"])


@query(
    "perf_measures",
    "select *, round((tp+tn)/(tp+fp+tn+fn),6) as accuracy, round(tp/(tp+fp),6) as ppv, round(tp/(tp+fn),6) as recall from (select sim_id, "
    "count(*) filter (score>0.5e0 and response=1) as tp, count(*) filter (score>0.5e0 and response=0) as fp, count(*) filter (score<=0.5e0 and response=0) as tn, "
    "count(*) filter (score<=0.5e0 and response=1) as fn from scores group by sim_id)",
)
def perf_measures(t, c):
    return rounded(stats.perf_measures(t.scores, 0.5, ["sim_id"]), ["accuracy", "ppv", "recall"])


@query(
    "confusion_matrix",
    "select (score>=0.5e0)::int as prediction, count(*) filter (response=0) as reference_0, count(*) filter (response=1) as reference_1 from scores group by 1",
)
def confusion_matrix(t, c):
    return stats.confusion_matrix(t.scores)


@query(
    "score_bucket_profile",
    "select bucket, variable, round(v,6) as mean_value from (select bucket, avg(score) as score, avg(response) as response, avg(user_id) as user_id from "
    "(select s.*, cast(least(floor((score-lo)/((hi-lo)/3)),2)+1 as int) as bucket from (select value/(value+20) as score, case when event_type='purchase' "
    "then 1 else 0 end as response, user_id from events) s, (select min(value/(value+20)) as lo, max(value/(value+20)) as hi from events)) group by bucket) "
    "unpivot (v for variable in (score, response, user_id))",
    raw=True,
)
def score_bucket_profile(t, c):
    rows = t.read("events").select(
        F.try_divide(F.col("value"), F.col("value") + 20).alias("score"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("response"),
        F.col("user_id").cast("double").alias("user_id"),
    )
    return rounded(stats.score_bucket_profile(rows, ["score", "response", "user_id"], 3), ["mean_value"])


# ---- correlation ------------------------------------------------------------------------------


@query(
    "corr_matrix",
    "select 'x' || i as var1, 'x' || j as var2, round(corr(cast(embedding[i+1] as double), cast(embedding[j+1] as double)),6) as corr "
    "from embeddings, ii, jj group by i, j",
    ENTRIES_SQL,
)
def corr_matrix(t, c):
    return rounded(stats.corr_matrix(t.features(), t.covariates), ["corr"])


# every entry, a scaled copy and the negative of each, and the sum of each with the next
PAIRS_SQL = """w as (select max(len(embedding)) as w from embeddings),
 v as (select list_transform(embedding, lambda z: cast(z as double)) as x from embeddings where embedding is not null),
 l as (select row_number() over () as row, list_concat(x, list_transform(x, lambda z: z*2+1), list_transform(x, lambda z: -z),
  list_transform(range(1, len(x)), lambda k: x[k] + x[k+1])) as x from v),
 lv as (select row, unnest(range(1, len(x)+1)) as i, unnest(x) as x from l),
 names as (select list_concat(list_transform(range(w), lambda k: 'x' || k), list_transform(range(w), lambda k: 'y' || k),
  list_transform(range(w), lambda k: 'z' || k), list_transform(range(w-1), lambda k: 's' || k)) as n from w),
 r as (select a.i as i, b.i as j, corr(a.x, b.x) as r from lv a join lv b on a.row = b.row and a.i < b.i group by a.i, b.i)"""


@query(
    "high_corr_pairs",
    "select n[i] as var1, n[j] as var2, round(r,6) as corr, (abs(r)>=1-1e-9)::int as drop_second from r, names where abs(r)>0.5e0",
    PAIRS_SQL,
)
def high_corr_pairs(t, c):
    """All covariates and, of each, a scaled copy, the negative and the sum with the next."""
    names = t.covariates
    rows = t.features().select(
        *names,
        *[(F.col(x) * 2 + 1).alias(f"y{i}") for i, x in enumerate(names)],
        *[(-F.col(x)).alias(f"z{i}") for i, x in enumerate(names)],
        *[(F.col(x) + F.col(y)).alias(f"s{i}") for i, (x, y) in enumerate(zip(names, names[1:], strict=False))],
        F.lit(1.0).alias("k"),
    )
    return rounded(stats.high_corr_pairs(rows, rows.columns), ["corr"])


SURVEY_MEANS_SQL = """sm as (select p_id, avg(capped_days_treatment) as days, avg(c061) as c061, avg(c062) as c062, avg(c070) as c070 from base
 join doc_survey on shortcode=short_id where market=1 and c061 is not null and c062 is not null and c070 is not null group by p_id)"""
ANSWERS = ["c061", "c062", "c070"]


@query(
    "corr_with_target",
    " union all ".join(
        f"select '{v}' as variable, round(corr({v},days),6) as pearson, round((select corr(rx, ry) from (select avg(a) over (partition by {v}) as rx, "
        f"avg(b) over (partition by y) as ry from (select {v}, y, row_number() over (order by {v}) as a, row_number() over (order by y) as b from "
        f"(select *, (days/30>=6)::int as y from sm)))),6) as spearman from sm"
        for v in ANSWERS
    ),
    SURVEY_MEANS_SQL,
)
def corr_with_target(t, c):
    """Pearson with the capped days, Spearman with six-month persistence."""
    means = agg.patient_mean_survey(c.base, t.doc_survey, ANSWERS).select(
        F.col("capped_days_treatment").alias("days"),
        *ANSWERS,
    )
    means = persist_stage(means.withColumn("y", (F.col("days") / 30 >= 6).cast("int")))
    pearson = stats.corr_with_target(means, "days", ANSWERS)
    return rounded(
        pearson.join(stats.spearman_with_target(means, "y", ANSWERS), "variable"), ["pearson", "spearman"]
    )


# ---- screens --------------------------------------------------------------------------------


SCREEN_SQL = """sc as (select p_id, cast(capped_days_treatment as double) as days, cast((p_id%2) as double) as odd, cast((p_id%997=0)::int as double) as rare,
 1.0e0 as one, cast(case when p_id%5=0 then null else p_id%3 end as double) as third, (capped_days_treatment>=180)::int as response,
 cast((capped_days_treatment>=180 and p_id%2=0)::int as double) as sub from pat_persistence)"""
COVARIATES = ["days", "odd", "rare", "one", "third", "sub"]


def screen_rows(t):
    p, d = F.col("p_id"), F.col("capped_days_treatment")
    return t.pat_persistence.select(
        "p_id",
        d.cast("double").alias("days"),
        (p % 2).cast("double").alias("odd"),
        (p % 997 == 0).cast("double").alias("rare"),
        F.lit(1.0).alias("one"),
        F.when(p % 5 != 0, p % 3).cast("double").alias("third"),
        (d >= 180).cast("int").alias("response"),
        ((d >= 180) & (p % 2 == 0)).cast("double").alias("sub"),
    )


@query(
    "covariate_screen",
    "select variable, is_constant, is_binary, case when is_binary=1 then total end as positives, "
    "(is_constant=0 and (is_binary=0 or total>=10))::int as keep from ("
    + " union all ".join(
        f"select '{v}' as variable, (count(distinct {v})=1)::int as is_constant, (count(distinct {v})=2)::int as is_binary, sum({v}) as total from sc where third is not null"
        for v in COVARIATES
    )
    + ")",
    SCREEN_SQL,
)
def covariate_screen(t, c):
    return stats.covariate_screen(screen_rows(t), COVARIATES)


_bin = ["odd", "rare", "sub"]


@query(
    "odds_ratio_screen",
    "select variable, a, b, c, d, round(case when b*c>0 then a*d/(b*c) end,6) as odds_ratio, (b*c=0 and a*d>0)::int as is_infinite, "
    "((b*c=0 and a*d>0) or (b*c>0 and a*d/(b*c)>10))::int as drop from ("
    + " union all ".join(
        f"select '{v}' as variable, count(*) filter ({v}=1 and response=1) as a, count(*) filter ({v}=0 and response=1) as b, "
        f"count(*) filter ({v}=1 and response=0) as c, count(*) filter ({v}=0 and response=0) as d from sc"
        for v in _bin
    )
    + ")",
    SCREEN_SQL,
)
def odds_ratio_screen(t, c):
    return rounded(stats.odds_ratio_screen(screen_rows(t), _bin), ["odds_ratio"])


@query(
    "complete_separation",
    "select *, (max_response_0<=min_response_1 or max_response_1<=min_response_0)::int as complete_separate from ("
    + " union all ".join(
        f"select '{v}' as variable, min({v}) filter (response=0) as min_response_0, min({v}) filter (response=1) as min_response_1, "
        f"max({v}) filter (response=0) as max_response_0, max({v}) filter (response=1) as max_response_1 from sc"
        for v in COVARIATES
    )
    + ")",
    SCREEN_SQL,
)
def complete_separation(t, c):
    return stats.complete_separation(screen_rows(t), COVARIATES)


@query(
    "gender_filter",
    'select p_id, "pat_gender_0_Max" from gender where "pat_gender_0_Max"+"pat_gender_1_Max"=1',
    GENDER_SQL,
)
def gender_filter(t, c):
    return stats.gender_filter(agg.gender_resolve(c.base))


@query(
    "best_levels",
    "select parameter, level, round(m,6) as mean_auc from (select *, row_number() over (partition by parameter order by round(m,12) desc, level) as rn from "
    "(select 'users' as parameter, cast(user_id%4 as double) as level, avg(value) as m from events group by 2 union all "
    "select 'hour', cast(hour(ts)%5 as double), avg(value) from events group by 2)) where rn=1",
    raw=True,
)
def best_levels(t, c):
    """The level choice of the grid search, on event values in place of AUCs."""
    rows = t.read("events").select(
        (F.col("user_id") % 4).alias("users"), (F.hour("ts") % 5).alias("hour"), F.col("value").alias("auc")
    )
    return rounded(stats.best_levels(rows, ["users", "hour"]), ["mean_auc"])
