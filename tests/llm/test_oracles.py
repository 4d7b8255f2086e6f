import pytest

from carrel.llm import queries
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE[name]))


def test_ten_operators():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 11))
