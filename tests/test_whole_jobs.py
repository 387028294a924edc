"""Queries whose job was once smaller or slower than the whole one."""

import numpy as np
import pytest
from check import compare, connect
from pyspark.sql import functions as F

from dosewise.bindings import ORACLES, QUERIES
from dosewise.bindings.adherence_queries import SETTINGS, pdc_rows
from dosewise.functions import ranks
from dosewise.operators import aggregate, forest, model, profiles, split
from dosewise.plans.cohort import Cohort
from dosewise.plans.pdc import build_pdc
from dosewise.sources.claims import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["pdc_by_class", "pdc_all_classes"])
def test_pdc_counts_every_product(spark, tables, key):
    assert "rare" not in ORACLES[key]
    got = QUERIES[key](spark, FOLDER)
    assert compare(got, connect(FOLDER), ORACLES[key]).startswith("ok")
    without = build_pdc(pdc_rows(Cohort(tables)), SETTINGS, None if key == "pdc_by_class" else "4 ATC3")
    assert got.agg({"days_covered": "sum"}).first()[0] > without.agg({"days_covered": "sum"}).first()[0]


def test_a_forest_fitted_in_parts_is_one_forest(spark, monkeypatch):
    data = [(i, int(i % 7 > 2), float(i % 7), float(i % 5)) for i in range(140)]
    rows = spark.createDataFrame(data, "id int, response int, a double, b double")
    sizes = []
    real = model.fit_forest
    monkeypatch.setattr(model, "PART", 4)
    monkeypatch.setattr(model, "fit_forest", lambda rows, n, *args, **kw: sizes.append(n) or real(rows, n, *args, **kw))
    trees, importance = model.fit_forest_parts(model.with_vector(rows, ["a", "b"]), 10, 1, 5, 2, depth=4)
    assert sorted(sizes) == [2, 4, 4] and len(trees.root) == 10
    assert importance.sum() == pytest.approx(1) and importance[0] > importance[1]
    x = np.array([[r[2], r[3]] for r in data])
    by_tree = forest.tree_scores(trees, x, np.arange(10)).mean(axis=1)
    got = {r["id"]: r["score"] for r in model.forest_scores(trees, rows, ["a", "b"], ("id",)).collect()}
    assert [got[r[0]] for r in data] == pytest.approx(list(by_tree))


def test_importance_of_a_forest_fitted_in_parts(spark, monkeypatch):
    """Few rows are dealt to many tasks, and every column is shuffled."""
    monkeypatch.setattr(model, "PART", 4)
    rows = spark.createDataFrame([(i, int(i % 7 > 2), float(i % 7), float(i % 5)) for i in range(140)], "id int, response int, a double, b double")
    trees, _ = model.fit_forest_parts(model.with_vector(rows, ["a", "b"]), 8, 2, 5, 2, depth=4)
    loss = {r["variable"]: r["auc_loss"] for r in model.permutation_importance(trees, rows, ["a", "b"]).collect()}
    assert loss["a"] > 0.2 > abs(loss["b"])


def test_grid_search_fits_forests_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, int(i % 7 > 2), float(i % 7), float(i % 5)) for i in range(280)], "id int, response int, a double, b double")
    sizes = []
    real = model.fit_forest
    monkeypatch.setattr(model, "PART", 4)
    monkeypatch.setattr(model, "fit_forest", lambda rows, n, *args, **kw: sizes.append(n) or real(rows, n, *args, **kw))
    grid = [{"ntree": n, "mtry": 1, "nodesize": 5} for n in (3, 6)]
    report = model.rf_grid_search(split.stratified_split(rows, [1], 0.5, 0.25), ["a", "b"], grid, depth=4).collect()
    assert sorted(sizes[:2]) == [2, 4] and max(sizes) <= 4 and report[0]["test_auc"] > 0.9


def test_yearly_groups_travel_once(spark):
    columns = ["p_id", "transactiondate", "shortcode", "doc_speciality", "ddms_pha", "fcc", "atc", "otc", "doc_gender", "rsp", "units"]
    data = [(p, 19950101 + 10000 * y + d, d, "1", d % 2, d % 3, "a", None, 1, 2.0, 1.5) for p in (1, 2) for y in (0, 1) for d in range(5)]
    years = aggregate.yearly_utilisation(spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in zip(columns, "int int int string int int string string int double double".split(), strict=True))))
    plan = years._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan
    got = years.where("p_id = 1 and year = 1996").first()
    assert (got.cnt_tx, got.cnt_docs, got.cnt_pharmacies, got.cnt_fcc, got.cnt_otc, got.sum_spending) == (5, 5, 2, 3, 0, 15.0)


def test_compare_tables_joins_the_claims_once(spark):
    read = QUERIES["compare_tables"](spark, FOLDER).inputFiles()
    assert read and not [f for f in read if "lineitem" in f]  # both sides and the index dates read the staged claims


def test_distinct_claims_are_those_of_repeated_tables(tables):
    class Repeated(Tables):
        def read(self, name):
            rows = super().read(name)
            return rows.union(rows.limit(50)) if name in ("lineitem", "orders", "part", "supplier") else rows

    repeated = Repeated(tables.spark, FOLDER)
    got, expected = repeated.distinct_rx, repeated.rx.distinct()
    assert got.schema == expected.schema and got.count() == expected.count() < repeated.rx.count()
    assert got.exceptAll(expected).isEmpty()


def test_a_forest_takes_few_fits():
    """A fit has its own jobs for each level and for its nodes, however few trees it has."""
    assert model.part_sizes(800) == [100] * 8 and sum(model.part_sizes(1550)) == 1550


def test_forests_are_fitted_on_few_partitions(spark, monkeypatch):
    """Every partition of a fit hands on the sums of all nodes, so few rows are few partitions."""
    rows = spark.createDataFrame([(i, int(i % 7 > 2), float(i % 7), float(i % 5)) for i in range(280)], "id int, response int, a double, b double").repartition(8)
    parts = []
    real = model.fit_forest
    monkeypatch.setattr(model, "fit_forest", lambda rows, *args, **kw: parts.append(rows.rdd.getNumPartitions()) or real(rows, *args, **kw))
    trees, _ = model.fit_forest_parts(model.with_vector(rows, ["a", "b"]), 4, 1, 5, 2, depth=4)
    grid = [{"ntree": 4, "mtry": 1, "nodesize": 5}]
    model.rf_grid_search(split.stratified_split(rows, [1], 0.5, 0.25), ["a", "b"], grid, depth=4)
    assert parts == [1, 1, 1] and len(trees.root) == 4
    monkeypatch.setattr(model, "FIT_ROWS", 100)
    spread = model.fit_rows(model.with_vector(rows, ["a", "b"]))
    assert 1 < spread.rdd.getNumPartitions() <= 3 and spread.count() == 280


@pytest.mark.parametrize("ways", [2, 3, 16, 256])
def test_values_find_their_bucket_by_halves(spark, ways):
    """A value is not compared with every cut; the bucket is the number of cuts below it all the same."""
    rows = spark.range(-5, 320).selectExpr("id % 2 as g", "id / 2d as v", "1 as n").union(spark.sql("select 0L, double('nan'), 1"))
    cut, (name,) = ranks.bucketed(rows, "v", ["g"], per_bucket=200, ways=ways)
    assert "filter(" not in cut._jdf.queryExecution().optimizedPlan().toString().lower().replace("filter (", "")
    sketch = F.percentile_approx("v", [i / ways for i in range(1, ways)], max(ranks.ACCURACY, ways)).alias("c")
    counted = rows.join(rows.groupBy("g").agg(sketch), "g").select("g", "v", F.size(F.filter("c", lambda e: e < F.col("v"))).alias("b"))
    assert cut.select("g", "v", name).exceptAll(counted).isEmpty() and cut.count() == 326


def test_short_texts_are_counted_as_they_are(spark):
    """A key is a text of less than 64 bytes or a hash, and no text is taken for the hash of another."""
    long = "x" * 100
    digest = spark.range(1).select(F.sha2(F.lit(long), 256)).first()[0]
    rows = spark.createDataFrame([(t,) for t in ("a", "a", "b ", long, long, digest, None)], "t string")
    keys = {r["key"]: r["n"] for r in profiles.typed_counts(rows, {"t": "text"}).collect()}
    assert keys["a"] == 2 and keys["b "] == keys[None] == 1 and keys[digest] == 2 and len(keys) == 5
