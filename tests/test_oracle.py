"""Every registered query of the core against its SQL."""

import pytest

from condense.plans import catalog, oracle


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_sql(spark, sf, duck, same, name):
    same(catalog.QUERIES[name](spark, sf), duck.execute(oracle.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracle.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
