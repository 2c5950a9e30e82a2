import pytest

from cuemill.plans import registry
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name]) > 0
