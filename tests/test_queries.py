"""Every query that SQL can express gives the rows that DuckDB gives; the registry is complete."""

import pytest
from conftest import same_rows

from specula.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    same_rows(registry.QUERIES[name](spark, sf), duck.execute(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_plans(spark, sf):
    for name, f in registry.QUERIES.items():
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
