import pytest

from riskweave.llm.oracles import SQL
from riskweave.llm.queries import REGISTRY
from tests.compare import connect, difference
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(REGISTRY[name](spark, SF).toPandas(), connect(SF).execute(SQL[name]).fetchdf()) is None
