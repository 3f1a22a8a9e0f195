import pytest

from guardlake.plans import QUERIES
from oracle import check


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, sf, name):
    query, sql = QUERIES[name]
    check(spark, query, sql, sf)


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if not sql])
def test_query_runs(spark, sf, name):
    assert QUERIES[name][0](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
