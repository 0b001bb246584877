"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as contract
from compare import difference, open_tables
from rookery.registry import oracle, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return open_tables(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, SQL[name]) is None


def test_the_contract_has_all_queries():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["viewer_id", "post_id"]
