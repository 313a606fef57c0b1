"""Scalar expressions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from noteloom.functions import metre, patterns, pitch


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_pitch_tokens(spark):
    tokens = ["C4", " C#4 ", "B-3", "F##5", "E--2", "H4", "Rest", "", "C", "A10", "C--1"]
    got = values(spark, pitch.name_to_midi(F.col("t")), [(t,) for t in tokens], "t string")
    assert got == [60, 61, 58, 79, 38, None, None, None, None, 141, 22]


def test_pitch_faults(spark):
    tokens = ["C4", " B-3 ", "H4", "c4", "Cx4", "C", "C#", "", "  ", None, "C2147483647", "D99999999999999999999"]
    got = values(spark, pitch.pitch_fault(F.col("t")), [(t,) for t in tokens], "t string")
    assert got == [None, None, "unknown letter", "unknown letter", "unknown accidental", "no octave", "no octave",
                   "empty", "empty", "empty", "octave out of range", "octave out of range"]
    got = values(spark, pitch.name_to_midi(F.col("t")), [(t,) for t in tokens], "t string")
    assert got == [60, 58] + [None] * 10


def test_pitch_names_and_steps(spark):
    got = values(spark, pitch.midi_to_name(F.col("m")), [(m,) for m in (36, 58, 60, 61, 63, 66, 68, 84)], "m int")
    assert got == ["C2", "B-3", "C4", "C#4", "E-4", "F#4", "A-4", "C6"]
    got = values(spark, pitch.midi_to_diatonic(F.col("m")), [(60,), (71,), (72,)], "m int")
    assert got == [28, 34, 35]


def test_accidental_tokens(spark):
    tokens = ["n", "s", "ss", "x", "xs", "f", "ff", "tf", " S ", "sss", "ffff", "sf", "q", "", None]
    got = values(spark, pitch.accidental_semitones(F.col("t")), [(t,) for t in tokens], "t string")
    assert got == [0, 1, 2, 2, 3, -1, -2, -3, 1, 3, -4, 0, 0, 0, 0]


# (midi, dpos) of the two notes -> q, d, z, c
PAIRS = [
    ((60, 28), (60, 28), "P1", "1", "0", "0"),
    ((60, 28), (62, 29), "M2", "2", "1", "2"),
    ((62, 29), (60, 28), "-M2", "-2", "-1", "-2"),
    ((60, 28), (61, 28), "A1", "1", "0", "1"),
    ((61, 28), (60, 28), "-A1", "1", "0", "-1"),
    ((60, 28), (63, 30), "m3", "3", "2", "3"),
    ((60, 28), (66, 31), "A4", "4", "3", "6"),
    ((60, 28), (66, 32), "d5", "5", "4", "6"),
    ((60, 28), (79, 39), "P12", "12", "11", "19"),
    ((53, 24), (71, 34), "A11", "11", "10", "18"),
    ((60, 28), (65, 32), "dd5", "5", "4", "5"),
    ((60, 28), (62, 30), "d3", "3", "2", "2"),
    ((60, 28), (72, 35), "P8", "8", "7", "12"),
]


@pytest.mark.parametrize("column,kind", [(2, "q"), (3, "d"), (4, "z"), (5, "c")])
def test_intervals(spark, column, kind):
    rows = [(*a, *b) for a, b, *_ in PAIRS]
    token = pitch.interval(kind, F.col("m0"), F.col("d0"), F.col("m1"), F.col("d1"))
    assert values(spark, token, rows, "m0 int, d0 int, m1 int, d1 int") == [p[column] for p in PAIRS]


def test_simple_intervals(spark):
    rows = [(60, 28, 72, 35), (60, 28, 76, 37), (76, 37, 60, 28)]
    schema = "m0 int, d0 int, m1 int, d1 int"
    args = [F.col(c) for c in ("m0", "d0", "m1", "d1")]
    assert values(spark, pitch.interval("q", *args, compound=False), rows, schema) == ["P1", "M3", "-M3"]
    assert values(spark, pitch.interval("d", *args, compound=False), rows, schema) == ["1", "3", "-3"]
    assert values(spark, pitch.interval("c", *args, compound=False), rows, schema) == ["0", "4", "-4"]
    with pytest.raises(ValueError):
        pitch.interval("x", *args)


def test_orders():
    with pytest.raises(ValueError):
        pitch.order_position(F.lit(0), "sideways")


def test_fifths(spark):
    got = values(spark, pitch.order_position(F.col("p"), " Fifths "), [(p,) for p in (0, 7, 2, 6, 5)], "p int")
    assert got == [0, 1, 2, 6, 11]


def test_pattern_text(spark):
    rows = [("2_2_-3",), (" 2, 2 ,-3",), ("M2__P5_",), ("",), ("M10_P5, M3_P4",)]
    got = values(spark, patterns.pattern_key(F.col("t")), rows, "t string")
    assert got == ["2_2_-3", "2_2_-3", "M2_P5", "", "M10_P5, M3_P4"]
    got = values(spark, patterns.pattern_key(F.col("t"), comma_first=True), rows[-1:], "t string")
    assert got == ["M10_P5_M3_P4"]


def test_part_labels(spark):
    rows = [("1,2",), ("2_1",), ("1::3",), (" 4 - 2 ",), ("1/2,3",), ("7",)]
    got = values(spark, patterns.part_labels(F.col("t")), rows, "t string")
    assert got == [["1", "2"], ["2", "1"], ["1", "3"], ["4", "2"], ["1", "2", "3"], ["7"]]


def test_labels(spark):
    rows = [("Song", "f"), ("Unknown", "f"), (None, "f"), ("", "f")]
    assert values(spark, patterns.score_label(F.col("t"), F.col("f")), rows, "t string, f string") == ["Song", "f", "f", "f"]


def test_beat_strength(spark):
    places = [(0, 4, 4), (480, 4, 4), (960, 4, 4), (240, 4, 4), (120, 4, 4), (60, 4, 4), (720, 6, 8), (480, 3, 4), (0, None, None)]
    got = values(
        spark,
        metre.beat_strength(F.col("m"), F.lit(480), F.col("c"), F.col("u")),
        places, "m int, c int, u int",
    )
    assert got == [1.0, 0.25, 0.5, 0.125, 0.0625, 0.03125, 0.5, 0.5, None]


@pytest.mark.parametrize(("count", "unit", "want"), [
    (3, 4, [1.0, 0.25, 0.5, 0.25, 0.5, 0.25]),
    (6, 8, [1.0, 0.25, 0.25, 0.5, 0.25, 0.25]),
    (9, 8, [1.0, 0.25, 0.25, 0.5, 0.25, 0.25, 0.5, 0.25, 0.25]),
    (12, 8, [1.0, 0.125, 0.125, 0.25, 0.125, 0.125, 0.5, 0.125, 0.125, 0.25, 0.125, 0.125]),
    (2, 2, [1.0, 0.125, 0.25, 0.125, 0.5, 0.125, 0.25, 0.125]),
])
def test_weights_of_every_eighth(spark, count, unit, want):
    places = [(240 * k, count, unit) for k in range(len(want))]
    weight = metre.beat_strength(F.col("m"), F.lit(480), F.col("c"), F.col("u"))
    assert values(spark, weight, places, "m int, c int, u int") == want


def test_velocity(spark):
    assert values(spark, pitch.audible_velocity(F.col("v")), [(0,), (42,), (None,)], "v int") == [64, 42, None]
