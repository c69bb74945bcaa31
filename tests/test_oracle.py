"""Every registered query next to its SQL."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_point
from semspace.bindings import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL_FREE = {"explained_variance", "kmeans_clusters", "layout_pca", "lsa_embed", "pca_reduce", "reach_closure"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    ok, note = compare(name, spark, con, SF)
    assert ok, note


def test_contract(spark):
    assert set(QUERIES) - set(ORACLE) == SQL_FREE
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())
    assert entry_point.entry(spark).columns == ["item_id", "rank", "anchor_idx", "z"]
