"""Plan guards for every registered query (regression checks on plan shape)."""

import pytest

from poslake.plans.catalog import queries

QUERIES = queries()
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython")
PYTHON_ALLOWED = {"reassemble"}  # M1 framing: Arrow-batched pandas over bounded segments


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    if name not in PYTHON_ALLOWED:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan, name
