import oracle
import pytest

from borei.plans import catalog

NO_SQL = sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, smallest, name):
    got, want = oracle.both(spark, smallest, name, catalog.QUERIES, catalog.ORACLES)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", NO_SQL)
def test_query_without_sql_runs(spark, smallest, name):
    df = catalog.QUERIES[name](spark, smallest)
    assert df.columns and df.count() >= 0
