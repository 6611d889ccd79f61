import oracle
import pytest

from paperloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLES[name]) is None


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
