import pytest

import __spark_entry__ as entry
from riskweave import oracles
from riskweave.queries import REGISTRY
from tests.compare import connect, difference
from tests.conftest import SF

SQL = oracles.all_sql()
QUERIES = REGISTRY


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_keeps_every_row(spark, name):
    result = QUERIES[name](spark, SF)
    assert result.count() == QUERIES["scan_transactions"](spark, SF).count()


def test_every_statement_has_its_query():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
