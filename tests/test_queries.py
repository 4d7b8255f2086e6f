import pytest

from carrel import registry
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
