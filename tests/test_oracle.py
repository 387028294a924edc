"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect

from __spark_entry__ import CORPUS_QUERIES, entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SLOW = {"model_run"}
#: The queries of the optional corpus operators have tests of their own.
OWN = set(queries()) - set(CORPUS_QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(set(oracle_sql()) & OWN))
def test_matches_sql(spark, con, key):
    result = compare(queries()[key](spark, FOLDER), con, oracle_sql()[key])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("key", sorted(OWN - set(oracle_sql()) - SLOW))
def test_rows_only(spark, key):
    assert queries()[key](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert "cnt_tx_days" in df.columns and df.count() > 0


def test_names_are_registered_once():
    assert set(oracle_sql()) <= set(queries())
    assert not [k for k in OWN if "pipeline" in k]
