"""Each query of the domain's operators against its SQL in DuckDB."""

import pytest
from checks import same

from loomstead.plans import registry


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(name, spark, sf_dir, duck):
    same(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark, sf_dir):
    """Filters and columns reach the scan, and the latest child is found before flags are counted."""
    plan = registry.queries()["filter_point_lookup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,42)" in plan and "c_mktsegment" not in plan
    plan = registry.queries()["lateral_latest_stale_count"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
