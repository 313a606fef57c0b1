"""The rows that a projection shuffles are narrow: texts and derived columns are made afterwards."""

import pytest

from noteloom.plans import projection


@pytest.mark.parametrize("build", [projection.project_events, projection.project_lineitem])
def test_only_plain_numbers_are_shuffled(spark, sf_dir, build):
    plan = build(spark, sf_dir)._jdf.queryExecution().executedPlan()
    wide = [line for line in plan.toString().splitlines() if "Sort [" in line or "Exchange" in line]
    assert wide and not any("note_id" in line or "piece_id" in line for line in wide)
    below = plan.toString().split("Exchange hashpartitioning", 1)[1]
    assert "note_id" not in below and "concat" not in below
