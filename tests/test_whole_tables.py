"""Queries read whole tables."""

import pytest

from runsight.plans import registry


@pytest.mark.parametrize("name", ["steady_verdict", "target_checks", "residual_last_groups", "step_health", "layer_match"])
def test_no_part_of_a_table_is_left_out(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "Filter (l_linenumber" not in plan and "Filter (c_custkey" not in plan
