"""Every registered query against its SQL on the driver's tables."""

import pytest

from placewatch.catalog import ORACLES, QUERIES

from .conftest import SF
from .oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    if key in ORACLES:
        out = compare(spark, con, QUERIES[key], ORACLES[key], SF)
        assert out is None, out
    else:
        assert QUERIES[key](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert len(df.columns) == 26 and df.count() == 150
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_cross_joins(spark):
    """The products with joins keep to equi-joins."""
    for key in ("Q-03", "Q-04", "Q-06", "Q-10", "Q-13", "Q-18-nearby", "SPA-05-grid", "VEC-01", "AGG-07"):
        plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
