import pytest

from cuemill.llm import registry
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) > 0
