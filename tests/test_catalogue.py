"""Every registered engine query against DuckDB on the same files."""

import pytest
from helpers import assert_same, duck

from tessella import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLE_SQL:
        assert_same(df, con, queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, sf_dir):
    """Filters and columns reach the scan; IN subqueries are joins on equality."""
    s = queries.session(spark, sf_dir)
    plan = s.query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.0")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    for how, sql in (("LeftAnti", "NOT IN"), ("LeftSemi", "IN")):
        plan = s.query(f"SELECT c_custkey FROM customer WHERE c_custkey {sql} (SELECT o_custkey FROM orders)")._jdf.queryExecution().executedPlan().toString()
        assert how in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    plan = s.query("SELECT s.s_name AS s, n.n_name AS n FROM supplier AS s, nation AS n WHERE s.s_nationkey = n.n_nationkey")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and "Cartesian" not in plan
