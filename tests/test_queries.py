"""Every graph query against DuckDB on the same tables."""

import pytest

from tests.oracle import check, connect
from weftgraph.queries import ORACLE_SQL, QUERIES

SLOW = {"taint_depth_cap"}  # 49 levels; its rule is tested on a chain in test_analyses


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf_dir, con, name):
    check(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "depth"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
