"""Every registered query at the smallest scale, against its SQL where there is one."""

import os
import pathlib

import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare, connect

# Their SQL takes half a minute each, and the embeddings are the same 500 vectors at sf0.001 and sf0.01, where
# check_oracle.py compares them; here the jobs only have to run.
SLOW_SQL = {"average_linkage_tree", "average_linkage_clusters", "threshold_sweep", "threshold_labels", "spanning_tree"}
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


@pytest.fixture
def con():
    """One database per test: a fatal error in one leaves the others alone."""
    with connect(SF) as database:
        yield database


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    sql = None if name in SLOW_SQL else entry.oracle_sql().get(name)
    assert compare(spark, con, SF, entry.queries()[name], sql) == ""


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["query_table", "query_col", "cand_table", "cand_col", "rank", "score"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(TABLES) == 14
