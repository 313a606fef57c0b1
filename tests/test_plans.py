"""Shapes that must not appear in the plans of registered queries."""

import pytest

from noteloom.plans import projection
from noteloom.plans.queries import QUERIES
from noteloom.operators import excerpt, intervals, ngrams

# Reading documents is the only place where rows pass through Python.
PYTHON = {
    "document_states", "document_metadata", "document_events", "document_harmonic", "document_performed", "measure_timeline",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for shape in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert shape not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "MapInArrow" not in plan


def windows(df):
    return [line for line in plan_of(df).splitlines() if "Window [" in line or "Window(" in line]


def test_windows_over_notes_are_per_block(spark, sf_dir):
    events = projection.note_events(spark, sf_dir)
    for df in (
        ngrams.melodic_ngrams(events, 3, entries=True),
        intervals.melodic_intervals(events),
    ):
        found = windows(df)
        assert found and all("__block" in w for w in found)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    events = projection.note_events(spark, sf_dir)
    plan = plan_of(excerpt.measure_range(events, 5, 12).select("piece_id", "midi"))
    assert "GreaterThanOrEqual(measure,5.0)" in plan and "LessThanOrEqual(measure,12.0)" in plan
    assert "ReadSchema: struct<piece_id:string,measure:double,midi:int>" in plan


def test_counts_read_no_ids(spark, sf_dir):
    events = projection.note_events(spark, sf_dir)
    plan = plan_of(ngrams.count_patterns(ngrams.melodic_ngrams(events, 3)))
    assert "note_ids" not in plan and "pitches" not in plan


def test_one_shuffle_serves_both_sides_of_the_pairs(spark, sf_dir):
    df = intervals.harmonic_intervals(projection.note_events(spark, sf_dir))
    df.write.format("noop").mode("overwrite").save()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(intervals.harmonic_intervals(projection.note_events(spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") == 2
