"""Values at the edge: pitches below C0, many parts, late onsets, equal measure numbers, endless ranges."""

import pytest
from noteloom.operators import cadence, ngrams, sonority, spans
from pyspark.sql import functions as F

LATE = (1 << 47) + 960


def test_first_occurrence_of_late_and_many_parts(spark):
    rows = [("p", part, onset, "2_2") for part, onset in ((70000, LATE), (70001, LATE), (3, LATE + 480))]
    found = spark.createDataFrame(rows, "piece_id string, part int, onset_ppq bigint, pattern_string string").withColumns({
        "dur_ppq": F.lit(480).cast("bigint"), "end_ppq": F.col("onset_ppq") + 480, "ppq": F.lit(480),
        "note_ids": F.array(F.col("part").cast("string")),
    })
    first = ngrams.first_occurrences(found).first()
    assert (first["part"], first["count"], first["start_q"]) == (70000, 3, LATE / 480)


def _events(spark, rows):
    """Events from (part, onset, dur, midi, dpos), measure 1 of length 1,920 throughout."""
    table = spark.createDataFrame(rows, "part int, onset_ppq bigint, dur_ppq bigint, midi int, dpos int")
    place = F.expr("row_number() over (partition by part order by onset_ppq)")
    return table.withColumns({
        "piece_id": F.lit("p"), "staff": F.col("part").cast("string"), "ppq": F.lit(480),
        "seq": place.cast("bigint"), "note_place": F.when(F.col("midi").isNotNull(), (place - 1).cast("bigint")),
        "measure": F.lit(0.0), "measure_seq": F.expr("onset_ppq div 1920 + 1"), "measure_onset_ppq": F.col("onset_ppq") % 1920,
        "meter_count": F.lit(4), "meter_unit": F.lit(4), "fermata": F.lit(False), "section_start": F.lit(False),
        "pitches": F.when(F.col("midi").isNotNull(), F.array(F.struct("midi", (F.col("midi") % 12).alias("pc"), F.lit(1).alias("vel")))),
        "note_ids": F.when(F.col("midi").isNotNull(), F.array(F.concat_ws("-", "part", "onset_ppq"))),
    })


def test_low_line_below_c0(spark):
    # B-1 (midi 11) to C0 (12), in a part beyond 16 bits.
    rows = [(1, 0, 1920 * 3, 60, 28), (70000, 0, 1920, 11, -1), (70000, 1920, 1920, 12, 0), (70000, 3840, 1920, None, None)]
    items = sonority.low_line_items(sonority.sonorities(_events(spark, rows))).orderBy("onset_ppq").collect()
    assert items[0]["low_line"] == "m2"


def test_spans_over_equal_measure_numbers_and_endless_ranges(spark):
    rows = [(1, 1920 * k, 1920, 60 + k, 28 + k) for k in range(40)]
    events = _events(spark, rows)
    asked = spark.createDataFrame(
        [("p", 1, 0.0, 1.0, None, None, 2, None), ("p", 2, None, None, 8.0, 1e9, None, "-"), ("p", 3, None, None, 1e12, 1e13, None, None)],
        "piece_id string, index bigint, start_measure double, start_beat double, start_q double, end_q double, note_count int, part string",
    )
    found = {r["index"]: r["note_ids"] for r in spans.resolve_spans(events, asked).collect()}
    assert found[1] == ["1-0", "1-1920"]
    assert found[2] == [f"1-{1920 * k}" for k in range(2, 40)]
    assert found[3] == []


@pytest.mark.parametrize("rests", ["low", "high"])
def test_a_suspension_into_silence_is_evaded(spark, rests):
    # 7-6 over a held tenor, then one of the voices rests.
    low = [(2, 0, 1920, 62, 29), (2, 1920, 960, None if rests == "low" else 60, None if rests == "low" else 28)]
    high = [(1, 0, 480, 72, 35), (1, 480, 480, 72, 35), (1, 960, 960, 71, 34), (1, 1920, 960, None if rests == "high" else 72, None if rests == "high" else 35)]
    closes = cadence.cadence_formulas(_events(spark, low + high)).select("onset_ppq", "cad_type").distinct().collect()
    assert [tuple(r) for r in closes] == [(1920, "Evaded")]


def test_section_starts_are_entries(spark, events):
    moved = events.withColumn("section_start", F.col("seq") % 7 == 0)
    starts = {(r.piece_id, r.part, r.seq) for r in ngrams.melodic_ngrams(moved, 2).filter("seq % 7 = 0").collect()}
    found = {(r.piece_id, r.part, r.seq) for r in ngrams.melodic_ngrams(moved, 2, entries=True).collect()}
    assert starts and starts <= found
