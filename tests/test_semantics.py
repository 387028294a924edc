"""Missing-value, ordering and tie rules on hand-made frames, checked by brute force."""

import datetime as dt
import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from dosewise.functions import at_most, below, blank_to_null, parse_date_int, parse_number
from dosewise.functions.ranks import average_ranks, hash_row_number, order_statistics, value_counts
from dosewise.operators import adherence as adh
from dosewise.operators import aggregate as agg
from dosewise.operators import compare, derive, joins, profiles, reshape, split, stats


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def definition_5(values, p):
    x = sorted(values)
    n = len(x)
    if n * p % 100 == 0:
        j = n * p // 100
        return (x[max(j, 1) - 1] + x[min(j, n - 1)]) / 2
    return x[n * p // 100]


def test_missing_sorts_below_everything(spark):
    df = spark.createDataFrame([(None,), (79,), (80,), (81,)], "supply int")
    assert df.where(at_most(F.col("supply"), 80)).count() == 3
    assert df.where(below(F.col("supply"), 80)).count() == 2


def test_anti_join_ignores_missing_ids(spark):
    ids = spark.createDataFrame([(1,), (2,)], "p_id int")
    listed = spark.createDataFrame([(1,), (None,)], "p_id int")
    assert rows_of(joins.anti_join(ids, listed, "p_id"), "p_id") == [(2,)]


def test_blank_and_number_and_date_parsing(spark):
    df = spark.createDataFrame([("  ", "1,234", 20130631), ("a ", "n/a", 20130630)], "a string, b string, c int")
    got = df.select(blank_to_null(F.col("a")), parse_number(F.col("b")), parse_date_int(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(None, 1234.0, None), ("a", None, dt.date(2013, 6, 30))]


@pytest.mark.parametrize("n, p5", [(10, 1.0), (20, 1.5)])
def test_percentile_definition_5(spark, n, p5):
    df = spark.range(1, n + 1).withColumnRenamed("id", "x")
    got = order_statistics(value_counts(df, "x"), "x", [5]).first()["p5"]
    assert got == p5


@pytest.mark.parametrize("per_bucket", [1_000_000, 100, 3])
def test_order_statistics_with_buckets_and_groups(spark, per_bucket):
    rng = random.Random(5)
    # a third of one group is a single value, the other values are heavy-tailed
    data = [("a", 7.0)] * 300 + [("a", round(rng.paretovariate(1), 3)) for _ in range(600)]
    data += [("b", float(rng.randrange(40))) for _ in range(501)] + [("c", 1.0)]
    df = spark.createDataFrame(data, "g string, x double")
    counts = value_counts(df, "x", ["g"])
    got = order_statistics(counts, "x", [5, 50, 95], "g", per_bucket=per_bucket, ways=4).collect()
    for r in got:
        mine = [x for g, x in data if g == r["g"]]
        for p in (5, 50, 95):
            assert r[f"p{p}"] == definition_5(mine, p)
        assert r["p50"] == statistics.median(mine)


def test_average_ranks_with_ties(spark):
    values = [3.0, 1.0, 3.0, 3.0, 2.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["x"]: r["avg_rank"] for r in average_ranks(value_counts(df, "x"), "x", per_bucket=2, ways=2).collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0, 5.0: 6.0}


def test_hash_row_number_equals_one_big_sort(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("d"))
    got = hash_row_number(df, ["g"], "d", "id").collect()
    for g in range(3):
        mine = sorted((r["d"], r["id"], r["rn"]) for r in got if r["g"] == g)
        assert [rn for _, _, rn in mine] == list(range(1, 1001))


def test_auc_with_ties_equals_pair_counting(spark):
    rng = random.Random(3)
    data = [(rng.randrange(2), rng.randrange(20) / 7) for _ in range(400)]
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg))
    df = spark.createDataFrame(data, "response int, score double")
    assert math.isclose(stats.auc_exact(df).first()["auc"], wins / len(pos) / len(neg), rel_tol=1e-12)


def test_lag_is_reset_by_product_and_patient(spark):
    fills = spark.createDataFrame(
        [("A", 1, 9, day(0)), ("A", 1, 8, day(10)), ("B", 1, 9, day(3)), ("B", 1, 9, day(30)), ("A", 2, 9, day(5))],
        "prod string, p_id int, fcc int, trans_date date",
    )
    got = rows_of(adh.refill_gap(fills).select("prod", "p_id", "trans_date", "fcc_matched", "gap_between"), "prod", "p_id", "trans_date")
    assert [(r[3], r[4]) for r in got] == [(None, None), (9, 10), (None, None), (None, None), (9, 27)]


def test_equal_shares_give_the_smaller_region(spark):
    data = [(1, 1, 7), (1, 2, 5), (1, 2, 5), (1, 3, None), (2, 1, None), (2, 2, 4)]
    df = spark.createDataFrame(data, "p_id int, transactiondate int, region_doc int")
    got = rows_of(agg.main_region(df), "p_id")
    assert got == [(1, 5, pytest.approx(1 / 3)), (2, 4, 0.5)]
    only_missing = spark.createDataFrame([(3, 1, None)], df.schema)
    assert agg.main_region(only_missing).count() == 0


def daily(spark, fills, index):
    return spark.createDataFrame(
        [("C", 1, day(index), day(d), float(n)) for d, n in fills],
        "atc3 string, p_id int, index_date date, trans_date date, actual_duration double",
    )


def test_overlapping_supply_is_not_carried_forward(spark):
    got = adh.proportion_days_covered(daily(spark, [(0, 30), (20, 30)], 60), 60).first()
    assert got["days_covered"] == 50 and got["pdc"] == pytest.approx(50 / 60)


def test_half_days_and_the_lookback_bound(spark):
    d = daily(spark, [(0, 30.5), (30, 100)], 60)
    episodes = rows_of(adh.coverage_episodes(d, 60).select("episnum", "days_covered", "cum_days_covered"), "episnum")
    assert episodes == [(1, 30.0, 30.0), (2, 30.0, 60.0)]
    assert adh.coverage_episodes(d, 61).count() == 0


def test_pdc_by_brute_force(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for p in range(40):
        days = sorted(rng.sample(range(300), rng.randrange(1, 9)))
        length = [rng.choice([10, 30.5, 45, 90]) for _ in days]
        rows += [("C", p, day(300), day(d), float(n)) for d, n in zip(days, length)]
        if 300 - days[0] >= 60:
            ends = [min(d + n, nxt) for d, n, nxt in zip(days, length, [*days[1:], 300])]
            expected[p] = sum(e - d for d, e in zip(days, ends)) / (300 - days[0])
    df = spark.createDataFrame(rows, "atc3 string, p_id int, index_date date, trans_date date, actual_duration double")
    got = {r["p_id"]: r["pdc"] for r in adh.proportion_days_covered(df, 60).collect()}
    assert got == pytest.approx(expected)
    assert all(0 < v <= 1 for v in got.values())


def test_missing_gap_is_compliant(spark):
    supply = spark.createDataFrame(
        [(1, day(0), None), (2, day(0), 100.0), (3, day(0), 100.0)], "p_id int, index_date date, days_supply_on_index double"
    )
    second = spark.createDataFrame([(1, day(50)), (2, day(110)), (3, day(111))], "p_id int, second_date date")
    got = rows_of(adh.second_script_compliance(supply, second).select("p_id", "gap", "compliance"), "p_id")
    assert got == [(1, None, 1), (2, 10.0, 1), (3, 11.0, 0)]


def test_split_counts_are_half_even_and_sum_up(spark):
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(20)], "id int, response int")
    got = {
        (r["split"], r["response"]): r["count"]
        for r in split.stratified_split(df, [1], 0.5, 0.1).groupBy("split", "response").count().collect()
    }
    # class sizes 5 and 15: 2.5 -> 2, 0.5 -> 0, 7.5 -> 8, 1.5 -> 2
    assert got == {("train", 1): 2, ("test", 1): 3, ("train", 0): 8, ("valid", 0): 2, ("test", 0): 5}
    flags = split.sampling_flag(df, 0.5, 0.1, 0.4).groupBy("flag", "response").count().collect()
    assert {(r["flag"], r["response"]): r["count"] for r in flags} == {
        (1, 1): 2, (0, 1): 3, (1, 0): 7, (2, 0): 1, (0, 0): 7,
    }
    with pytest.raises(ValueError):
        split.sampling_flag(df, 0.5, 0.5, 0.5)


def test_splits_repeat_and_differ_by_seed(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(200)], "id int, response int")
    once = rows_of(split.stratified_split(df, [1, 2], 0.4, 0.2), "sim_id", "id")
    assert once == rows_of(split.stratified_split(df.repartition(5), [1, 2], 0.4, 0.2), "sim_id", "id")
    assert [r[3] for r in once if r[2] == 1] != [r[3] for r in once if r[2] == 2]


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 4.0, 6.5), (1.0, 5.0, 6.0)], "k double, x double, y double")
    m = {(r["var1"], r["var2"]): r["corr"] for r in stats.corr_matrix(df, ["k", "x", "y"]).collect()}
    assert m["k", "x"] is None and m["k", "k"] is None and m["x", "x"] == pytest.approx(1)
    assert m["x", "y"] == m["y", "x"] == pytest.approx(0.7857142857)
    assert stats.corr_with_target(df, "y", ["k"]).first()["pearson"] is None
    assert stats.spearman_with_target(df, "y", ["k", "x"]).orderBy("variable").collect()[0]["spearman"] is None


def test_correlation_survives_a_large_offset(spark):
    rng = random.Random(1)
    x = [rng.random() for _ in range(200)]
    y = [a + rng.random() for a in x]
    df = spark.createDataFrame([(1e9 + a, b) for a, b in zip(x, y)], "x double, y double")
    got = stats.corr_matrix(df, ["x", "y"]).where("var1 = 'x' and var2 = 'y'").first()["corr"]
    assert got == pytest.approx(statistics.correlation(x, y), abs=1e-6)


def test_first_match_and_first_per_key(spark):
    lookup = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 0, "z")], "k int, ord int, v string")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "key int")
    got = rows_of(joins.first_match_lookup(rows, lookup, "key", "k", ["ord", "v"]).select("key", "v"), "key")
    assert got == [(None, None), (1, "a"), (2, None)]


def test_group_values_keep_missing_keys_and_copies(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (None, 3.0), (None, 1.0)], "k int, v double")
    got = rows_of(joins.with_group_values(df, ["k"], {"total": F.sum("v")}), "k", "v")
    assert got == [(None, 1.0, 4.0), (None, 3.0, 4.0), (1, 2.0, 4.0), (1, 2.0, 4.0)]


def test_match_merge_prefers_the_later_table(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "p_id int, s string, a int")
    b = spark.createDataFrame([(2, None, 5), (3, "w", 6)], "p_id int, s string, b int")
    got = rows_of(joins.match_merge_full([a, b]).select("p_id", "s", "a", "b"), "p_id")
    assert got == [(1, "x", 10, None), (2, None, 20, 5), (3, "w", None, 6)]


def test_early_market_rows_with_a_missing_date_are_deleted(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), (day(0), 1), (day(9), 1)], "trans_date date, market int")
    assert derive.drop_early_market(df, "2020-01-05").count() == 2


def test_therapy_flag_variants_for_a_blank_code(spark):
    df = spark.createDataFrame([(" ", "x", 0), ("C09A1", "PRASUGREL", 0), ("Z", "x", 0)], "atc string, mol1 string, market int")
    first = [r["other_drugs"] for r in derive.therapy_flags(df).collect()]
    second = [r["other_drugs"] for r in derive.therapy_flags(df, blank_atc_is_other=True).collect()]
    assert first == [None, 0, 1] and second == [1, 0, 1]
    assert derive.therapy_flags(df).collect()[1]["oral_anti_platelet"] == 1


def test_new_users_exclude_any_early_or_undated_fill(spark):
    df = spark.createDataFrame(
        [(1, day(1), 1), (1, day(9), 1), (2, day(9), 1), (3, None, 1), (3, day(9), 1), (4, day(9), 0)],
        "p_id int, trans_date date, market int",
    )
    got = agg.index_date(df, "2020-01-06", variant="new_users")
    assert rows_of(got, "p_id") == [(2, day(9))]


def test_too_many_levels_is_an_error_not_a_cut(spark):
    df = spark.range(20).withColumnRenamed("id", "c")
    with pytest.raises(ValueError):
        derive.levels_of(df, "c", limit=19)
    assert len(derive.levels_of(df, "c", limit=20)) == 20


def test_index_molecule_leaves_the_add_on_out(spark):
    df = spark.createDataFrame(
        [(1, "ADD", 300.0), (1, "B", 90.0), (1, "A", 90.0), (2, "ADD", 50.0)], "p_id int, molecule string, days_supply double"
    ).withColumn("index_date", F.lit(day(0)))
    got = rows_of(agg.index_molecule(df, "ADD").select("p_id", "molecule_on_index", "usable"), "p_id")
    assert got == [(1, "A", 1), (2, "ADD", 0)]


def test_outliers_on_every_level(spark):
    data = [
        (1, day(0), "A", 1, 13.0, 1), (2, day(0), "A", 1, 1.0, 13),
        (3, day(0), "A", 1, 7.0, 1), (3, day(0), "A", 2, 6.0, 1),
        (4, day(0), "A", 1, 7.0, 1), (4, day(0), "B", 2, 6.0, 1),
        (5, day(0), "A", 1, 7.0, 1), (5, day(1), "A", 1, 6.0, 1),
    ]
    df = spark.createDataFrame(data, "p_id int, trans_date date, prod string, fcc int, units double, rx_id int")
    assert rows_of(agg.outlier_patients(df), "p_id") == [(1,), (2,), (3,), (4,)]


def test_profile_parts_sum_to_the_total(spark):
    long = "x" * 100
    data = [("a",), ("A",), ("",), (None,), ("  ",), ("Unknown",), (long,), (long,), (long + "y",)]
    df = spark.createDataFrame(data, "c string")
    r = profiles.profile_char(df, ["c"]).first()
    assert (r["available"], r["blank"], r["sentinel"], r["distinct_values"]) == (5, 3, 1, 4)
    assert r["available"] + r["blank"] + r["sentinel"] == r["total"] == 9
    d = profiles.sentinel_detail(df, ["c"]).collect()
    assert [(x["value"], x["frequency"]) for x in d] == [("Unknown", 1)]


def test_profile_of_numeric_text(spark):
    data = [("1.5",), ("2.50",), ("2.5",), ("ni",), ("bad",), (None,)]
    r = profiles.profile_num(spark.createDataFrame(data, "c string"), ["c"]).first()
    assert (r["min"], r["median"], r["max"]) == (1.5, 2.5, 2.5) and r["mean"] == pytest.approx(6.5 / 3)


def test_table_summary_keeps_the_schema_order(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("n/a", None, 4.0)], "s string, i int, d double")
    got = profiles.table_summary(df).collect()
    assert [(r["position"], r["variable"], r["type"]) for r in got] == [
        (1, "s", "Character"), (2, "i", "Numeric"), (3, "d", "Numeric"),
    ]
    assert got[0]["sentinel"] == 1 and got[1]["blank"] == 1 and got[2]["median"] == 3 and got[2]["range"] == 2


def test_compare_values_sees_missing(spark):
    a = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y"), (3, 1.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 2.0, "x"), (2, 3.0, "y"), (3, 1.0, "q")], "k int, v double, s string")
    assert [r[0] for r in rows_of(compare.compare_values(a, b, "k", ["v", "s"]), "k")] == [2, 3]


def test_covariate_screen_and_separation(spark):
    data = [(i, float(i % 2), 1.0, float(i == 0), float(i), int(i >= 10)) for i in range(20)]
    df = spark.createDataFrame(data, "id int, half double, one double, rare double, num double, response int")
    got = {r["variable"]: tuple(r)[1:] for r in stats.covariate_screen(df, ["half", "one", "rare", "num"]).collect()}
    assert got["half"] == (0, 1, 10.0, 1) and got["one"][3] == 0 and got["rare"] == (0, 1, 1.0, 0) and got["num"] == (0, 0, None, 1)
    sep = {r["variable"]: r["complete_separate"] for r in stats.complete_separation(df, ["half", "num"]).collect()}
    assert sep == {"half": 0, "num": 1}


def test_odds_ratio_infinite_and_large(spark):
    data = [(1, 1, 1)] * 5 + [(0, 1, 0)] * 5 + [(1, 0, 0)] * 5 + [(0, 0, 0)] * 5
    df = spark.createDataFrame(data, "a int, response int, b int")
    got = {r["variable"]: (r["odds_ratio"], r["is_infinite"], r["drop"]) for r in stats.odds_ratio_screen(df, ["a", "b"]).collect()}
    assert got == {"a": (1.0, 0, 0), "b": (None, 1, 1)}


def test_best_level_is_the_argmax(spark):
    data = [(1, 300, 0.6), (1, 500, 0.7), (2, 800, 0.9), (2, 800, 0.8), (2, 300, 0.95)]
    df = spark.createDataFrame(data, "sim int, ntree int, auc double")
    assert {r["level"] for r in stats.best_levels(df, ["ntree"]).collect()} == {800.0}


def test_score_buckets_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.99,), (1.0,)], "score double")
    got = {r["bucket"]: r["mean_value"] for r in stats.score_bucket_profile(df, ["score"], 2).collect()}
    assert got == {1: 0.0, 2: pytest.approx((0.5 + 0.99 + 1.0) / 3)}
    same = spark.createDataFrame([(0.3,), (0.3,)], "score double")
    assert stats.score_bucket_profile(same, ["score"], 3).count() == 1


def test_age_bands_are_closed_on_the_right(spark):
    df = spark.createDataFrame([("g", 19.0, 2), ("g", 19.5, 1), ("g", -1.0, 1), ("g", 95.0, 4)], "group string, age double, n long")
    got = {r["band"]: (r["num"], r["rate"]) for r in agg.age_band_rates(df).collect()}
    assert got == {"(-0.1,19]": (2, 0.25), "(19,35]": (1, 0.125), "(-1.1,-0.1]": (1, 0.125)}


def test_pivot_names_have_no_blanks(spark):
    df = spark.createDataFrame([(1, "4 ATC3", 0.5)], "p_id int, c string, v double")
    assert reshape.pivot_wide(df, "p_id", "c", "v", ["4 ATC3"], "pro_").columns == ["p_id", "pro_4_ATC3"]


def test_auc_of_more_rows_than_a_product_of_longs_holds(spark, monkeypatch):
    """Weighted counts stand for more rows than a test can hold."""
    from dosewise.operators import stats

    monkeypatch.setattr(stats, "average_ranks", lambda counts, *a: spark.createDataFrame(
        [(0.1, 4_000_000_000, 1_000_000_000, 2_000_000_000.5), (0.9, 4_000_000_000, 3_000_000_000, 6_000_000_000.5)],
        "score double, n long, n_pos long, avg_rank double",
    ))
    rows = spark.createDataFrame([(1, 0.5)], "response int, score double")
    assert stats.auc_exact(rows).first()["auc"] == pytest.approx(0.75)


def test_winsorize_with_many_values(spark):
    from dosewise.operators.adherence import winsorize

    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    got = winsorize(df, "x").agg(F.min("x"), F.max("x")).first()
    assert tuple(got) == (5.5, 95.5)


def test_missing_covariates_are_an_error(spark):
    from dosewise.plans.modelling import prepare

    with pytest.raises(ValueError):
        prepare(spark.createDataFrame([(1, 0, 1.0)], "p_id long, y int, a double"), ["a", "nowhere"], "y")


def test_yearly_correlation_takes_all_years_and_measures(spark):
    got = queries()["yearly_correlation_all"](spark, "/root/testdata/sf0.001").collect()
    assert {r["measure"] for r in got} == set(agg.YEARLY_MEASURES) and len(agg.YEARLY_MEASURES) == 11
    assert {(r["year"], r["later_year"]) for r in got} == {(a, b) for a in range(1995, 2002) for b in range(a + 1, 2002)}
    assert len(got) == 11 * 21


def test_sparse_dummies_have_no_limit(spark):
    """More levels than columns could hold; numbers are dense within a family and null is no level."""
    from dosewise.operators.derive import level_dictionary, sparse_dummies

    rows = [(i % 50, "pack", f"l{i}") for i in range(3000)] + [(1, "pack", "l1"), (7, "kind", "a"), (8, "kind", None)]
    df = spark.createDataFrame(rows, "p_id long, family string, level string")
    numbers = {(r["family"], r["level"]): r["number"] for r in level_dictionary(df).collect()}
    assert sorted(n for (f, _), n in numbers.items() if f == "pack") == list(range(3000)) and numbers["kind", "a"] == 0
    got = {(r["p_id"], r["family"]): (r["width"], r["numbers"]) for r in sparse_dummies(df).collect()}
    assert got[7, "kind"] == (1, [0]) and (8, "kind") not in got
    for p in range(50):
        assert got[p, "pack"] == (3000, sorted(numbers["pack", f"l{i}"] for i in range(p, 3000, 50)))


def test_rarest_products_without_a_limit(spark):
    from dosewise.operators.aggregate import drop_rare_products

    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 3), ("d", 1), ("d", 2), ("d", 3)]
    df = spark.createDataFrame(rows, "prod string, p_id long")
    assert {r["prod"] for r in drop_rare_products(df, None).collect()} == {"a", "d"}
    assert {r["prod"] for r in drop_rare_products(df, 2).collect()} == {"d"}


def test_covariates_from_a_list_table(spark):
    from dosewise.plans.modelling import listed_covariates

    table = spark.createDataFrame([("x", 1), ("y", 0), ("z", 1), ("x", 1)], "variable string, use int")
    assert listed_covariates(table) == ["x", "z"]


def test_summary_by_a_list_of_types(spark):
    """Text read as dates and numbers; what can't be read counts but has no statistics."""
    from dosewise.operators.profiles import table_summary

    rows = [("2020-01-01 10:00", "1,000", "x"), ("2020-01-04", "2.5", "X"), ("unknown", "no number", " "), (None, "2.5", None)]
    df = spark.createDataFrame(rows, "day string, amount string, word string")
    got = {r["variable"]: r for r in table_summary(df, types={"amount": "number", "day": "date", "word": "text"}).collect()}
    day, amount, word = got["day"], got["amount"], got["word"]
    assert (day["available"], day["sentinel"], day["blank"], day["range"], day["type"]) == (2, 1, 1, 3.0, "Date")
    assert [str(day[f"{m}_date"]) for m in ("min", "max", "mean", "median")] == ["2020-01-01", "2020-01-04", "2020-01-02", "2020-01-02"]
    assert (amount["available"], amount["distinct_values"], amount["min"], amount["max"], amount["median"]) == (4, 3, 2.5, 1000.0, 2.5)
    assert (word["available"], word["blank"], word["distinct_values"], word["min"]) == (2, 2, 2, None)
    with pytest.raises(ValueError):
        table_summary(df, types={"day": "stamp"})


def test_yearly_moments_without_enough_patients(spark):
    """A single patient has no correlation; a patient's missing measure leaves only that pair out."""
    from dosewise.operators.aggregate import yearly_correlation

    cols = "p_id long, transactiondate int, shortcode long, doc_speciality string, ddms_pha int, fcc long, atc string, otc string, units double, rsp double, doc_gender int, transactiontype int, dci_vos int, capped_days_treatment int"
    make = lambda p, day, n, g: [(p, day, i, "11", 1, i, "A", "N", 1.0, 2.0 + n, g, 1, 0, 5) for i in range(n)]
    one = make(1, 20200105, 2, 1) + make(1, 20210105, 3, 1)
    alone = yearly_correlation(spark.createDataFrame(one, cols)).collect()
    assert all(r["corr_years"] is None for r in alone) and len(alone) == 11
    more = one + make(2, 20200105, 4, None) + make(2, 20210105, 5, 2) + make(3, 20200105, 6, 2) + make(3, 20210105, 1, 1)
    got = {r["measure"]: r["corr_years"] for r in yearly_correlation(spark.createDataFrame(more, cols)).collect()}
    import numpy as np

    assert got["cnt_tx"] == pytest.approx(np.corrcoef([2, 4, 6], [3, 5, 1])[0, 1])
    assert got["mean_doc_gender"] is None  # constant in the later year over the two patients that have both
