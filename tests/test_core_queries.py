import pytest

from duskveil.plans import registry

ORACLES = registry.oracles()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, against_sql, name):
    against_sql(spark, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    from .conftest import SMALL

    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "flag" in __spark_entry__.entry(spark).columns
