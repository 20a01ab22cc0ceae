import pytest

from skyweave.llm import queries
from tests.oracle import SMALL, compare, views


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    assert not compare(queries.queries()[name](spark, SMALL), queries.ORACLE_SQL[name], con)
