"""No nested loops in the plans of the heavier queries."""

import pytest

from nearpass.plans import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["c4_drop_jumps", "j1_pair_seconds", "w2_per_second_counts", "j4_window_exposure", "q1_error_samples"])
def test_no_nested_loop_or_cartesian_product(spark, key):
    plan = registry.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_jump_filter_reads_its_source_once(spark):
    plan = registry.QUERIES["c4_drop_jumps"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
    # the report view itself is a union of two readings
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1
