"""Physical plans keep the shapes that matter on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from dosewise.operators import aggregate as agg
from dosewise.operators.joins import first_per_key
from dosewise.plans.cohort import Cohort, history_utilisation
from dosewise.session import scratch_dir

FOLDER = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


def test_scans_read_only_what_is_used(tables):
    text = plan(Cohort(tables).index)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    lineitem = next(s for s in schemas if "l_orderkey" in s)
    assert set(re.findall(r"(\w+):", lineitem)) <= {"l_orderkey", "l_partkey", "l_suppkey"}
    assert "GreaterThanOrEqual(o_orderdate,1996-07-01" in text and "LessThan(o_orderdate,1997-07-01" in text


def test_first_per_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(first_per_key(df, ["k"], ["id"]), "simple")
    assert text.count("WindowGroupLimit") >= 2
    assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning")


def test_main_choice_needs_no_window(tables):
    assert "Window" not in plan(agg.main_region(Cohort(tables).base), "simple")


def test_no_python_in_the_claims_queries(tables):
    text = plan(history_utilisation(tables), "simple")
    assert "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("key", ["cohort_build", "pdc_by_class", "match_rates", "broadcast_scalar", "stratified_split", "auc_exact"])
def test_no_cross_joins(spark, key):
    text = plan(queries()[key](spark, FOLDER), "simple")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_hot_patient_is_split_at_run_time(spark):
    """A key with most of the rows, joined without broadcast, is handled by AQE."""
    names = (
        "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    )
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "-1")
        spark.conf.set(names[2], "64KB")
        spark.conf.set(names[3], "32KB")
        rows = spark.range(0, 400000, 1, 8).select(
            F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("p_id"), F.col("id").alias("v")
        )
        index = spark.range(0, 400000, 1, 4).select(F.col("id").alias("p_id"), F.lit(1).alias("one"))
        joined = rows.join(index, "p_id").groupBy("p_id").agg(F.sum("v").alias("v"))
        joined.collect()
        assert "skew=true" in plan(joined, "simple")
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark) != scratch_dir(spark)


def test_no_query_asks_sql_for_a_subset():
    for text in oracle_sql().values():
        assert "using sample" not in text.lower()


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest

    from dosewise import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.scratch_dir(Cluster())
    Context.master = "local[8]"
    assert session.scratch_dir(Cluster()).startswith(session.LOCAL_MASTER_FOLDER)
    session._stages.pop()


def test_stages_are_deleted_on_release(spark):
    import os

    from dosewise import session

    before = len(session._stages)
    df = session.stage(spark.range(3))
    path = session._stages[-1].removeprefix("file:")
    assert df.count() == 3 and os.path.exists(path)
    assert session.release_stages(spark, since=before) == 1 and not os.path.exists(path)


@pytest.mark.parametrize("key", ["pre_index_window", "semi_join"])
def test_claims_are_joined_once_for_rows_and_index_dates(spark, key):
    assert not any("lineitem" in f for f in queries()[key](spark, FOLDER).inputFiles())


@pytest.mark.parametrize("key", ["patient_mart", "model_table"])
def test_lines_are_read_once(spark, monkeypatch, key):
    from dosewise import sources
    from dosewise.plans import cohort, model_table, patient_mart

    plans = []
    for module in (cohort, model_table, patient_mart):
        monkeypatch.setattr(module, "persist_stage", lambda df: plans.append(plan(df)) or sources.persist_stage(df))
    plans.append(plan(queries()[key](spark, FOLDER)))
    assert sum(text.count("/lineitem.parquet]") for text in plans) == 1
