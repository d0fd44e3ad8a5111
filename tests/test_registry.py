"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from workload.check import compare

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["doc_id", "line_no", "line"] and df.count() > 0


def test_sql_has_queries():
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, name):
    df = entry_points.queries()[name](spark, SMALL)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        problem, _ = compare(df, sql, SMALL)
        assert problem is None
