"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tessera import registry

NO_SQL = [n for n in registry.QUERIES if n not in registry.ORACLE_SQL]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in NO_SQL if n != "h1_backref_parse"])
def test_query_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
