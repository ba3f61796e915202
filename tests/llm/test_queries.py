import pytest

from tests.compare import differs
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert not differs(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_each_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
