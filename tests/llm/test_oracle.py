import pytest

from paperloom.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert not compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
