"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare.differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = entry_points.entry(spark)
    rows = {r["column_name"]: r for r in df.collect()}
    assert set(rows) == {"customer_id", "customer_name", "city", "account_balance", "revenue", "priority"}
    assert rows["customer_id"]["unique_values"] == 150
