"""Aligned blocks: every point in an interval once, few rows for long intervals."""

import math

import pytest
from pyspark.sql import functions as F

from noteloom.operators import dyadic, intervals, sonority, spans
from noteloom.plans import projection

RANGES = [(0, 0), (0, 6), (0, 7), (1, 8), (5, 5), (7, 8), (3, 700), (0, 4095), (1, 4096), (-9, 70), (-4096, 8191), (13, 12)]
POINTS = sorted({p + d for pair in RANGES for p in pair for d in (-9, -8, -1, 0, 1, 8, 64)})


def held(first, last, point):
    return first <= point <= last


@pytest.mark.parametrize("deep", [0, 1, 3, 4])
def test_meet_is_the_comparison_of_all_with_all(spark, deep):
    some = spark.createDataFrame([(i % 2, i, a, b) for i, (a, b) in enumerate(RANGES * 2)], "k int, i int, a bigint, b bigint")
    points = spark.createDataFrame([(p % 2, p) for p in POINTS], "k int, p bigint")
    found = dyadic.meet(some, F.col("a"), F.col("b"), points, F.col("p"), ["k"], deep).collect()
    want = [(i % 2, i, p) for i, (a, b) in enumerate(RANGES * 2) for p in POINTS if p % 2 == i % 2 and held(a, b, p)]
    assert sorted((r.k, r.i, r.p) for r in found) == sorted(want)


@pytest.mark.parametrize("deep", [0, 2, 4])
def test_spread_says_what_a_block_is_to_its_interval(spark, deep):
    some = spark.createDataFrame(list(enumerate(RANGES)), "i int, r struct<a: bigint, b: bigint>").select("i", "r.*")
    rows = dyadic.spread(some, F.col("a"), F.col("b"), deep).collect()
    for i, (a, b) in enumerate(RANGES):
        mine = [r for r in rows if r.i == i]
        for r in mine:
            level, block = r.block & 7, r.block >> 3
            assert r.begins == (a >> 3 * level == block)
        units = [u for r in mine if r.covers for u in range(r.block >> 3 << 3 * (r.block & 7), (r.block >> 3) + 1 << 3 * (r.block & 7))]
        assert sorted(units) == list(range(a, b + 1))
        assert sum(r.begins for r in mine) == (deep + 1 if a <= b else 0)


@pytest.mark.parametrize("units", [1, 7, 8, 63, 1000, 32_768, 500_000])
def test_rows_of_an_interval(spark, units):
    row = spark.createDataFrame([(3, 3 + units - 1)], "a bigint, b bigint")
    rows = dyadic.covered(row, F.col("a"), F.col("b")).count()
    assert rows <= 14 * (1 + math.log(units, 8)) + units / 4096
    # Nothing is exploded before it is cut into blocks.
    plan = dyadic.covered(row, F.col("a"), F.col("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


def note(piece, part, seq, onset, length, midi):
    return (piece, part, seq, onset, length, 480, 1.0 + onset // 1920, onset % 1920, 4, 4, midi, 7 * (midi // 12) if midi else None)


NOTES = ("piece_id string, part int, seq bigint, onset_ppq bigint, dur_ppq bigint, ppq int, measure double, "
         "measure_onset_ppq bigint, meter_count int, meter_unit int, midi int, dpos int")


@pytest.fixture(scope="module")
def pedal(spark):
    """A held note under a whole piece, a shorter one, and an upper voice of quarters."""
    rows = [note("p", 3, 1, 0, 480 * 40_000, 36), note("p", 2, 1, 960, 480 * 1000, 48)]
    rows += [note("p", 1, i + 1, 480 * i, 480, 60 + i % 12) for i in range(40_000)]
    return spark.createDataFrame(rows, NOTES).repartition(8)


def test_a_pedal_note_costs_few_rows(pedal):
    per_note = intervals.time_blocks(pedal).filter("part = 3").count()
    assert per_note <= 14 * (1 + math.log(20_000, 8)) + 20_000 / 4096
    assert intervals.time_blocks(pedal).filter("part = 1").count() <= 40_000 * 5
    found = intervals.harmonic_intervals(pedal).groupBy("voice_pair").count().collect()
    # The short pedal meets what begins under it and what it begins under.
    assert {r.voice_pair: r["count"] for r in found} == {"3_1": 40_000, "3_2": 1, "2_1": 1000}
    table = sonority.sonorities(pedal)
    assert table.count() == 40_000 and table.filter("low_part = 3").count() == 40_000
    assert table.filter(F.size(F.split("sonority", "/")) == 2).count() == 1000


def test_a_span_over_a_million_quarters(spark):
    rows = [("p", 1, i, 480 * 4 * i, 480, 480, 1.0 + i, 0, 60, i, [f"n{i}"]) for i in range(250_000)]
    notes = spark.createDataFrame(
        rows,
        "piece_id string, part int, seq bigint, onset_ppq bigint, dur_ppq bigint, ppq int, measure double,"
        " measure_onset_ppq bigint, midi int, note_place bigint, note_ids array<string>",
    )
    asked = [("p", 0, 2.0, 1e6, None), ("p", 1, 4000.0, None, None), ("p", 2, 8.0, None, 200_000), ("p", 3, 0.0, 1e12, None)]
    wanted = spark.createDataFrame(asked, "piece_id string, index int, start_q double, end_q double, note_count int")
    found = spans.resolve(notes, wanted).groupBy("index").count().collect()
    assert {r["index"]: r["count"] for r in found} == {0: 249_999, 1: 1, 2: 200_000, 3: 250_000}


def test_blocks_of_long_notes_do_not_change_results(spark, sf_dir):
    events = projection.note_events(spark, sf_dir)
    keep = ["piece_id", "low_part", "high_part", "onset_ppq", "low_midi", "high_midi"]
    units = [sorted(map(str, intervals.sounding_pairs(events, ["midi"], q).select(*keep).collect())) for q in (1, 2)]
    stretched = events.withColumns({"onset_ppq": F.col("onset_ppq") * 64, "dur_ppq": F.col("dur_ppq") * 64})
    long = intervals.sounding_pairs(stretched, ["midi"], 1).withColumn("onset_ppq", F.expr("onset_ppq div 64"))
    assert units[0] == units[1] == sorted(map(str, long.select(*keep).collect()))
