import pytest

from lexcask.llm.queries import ORACLES, QUERIES

from ..duck import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)
