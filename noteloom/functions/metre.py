"""Metric weight of a place in a measure, and quarter-to-second arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: quarters added to an excerpt's end so that its last note rings out.
TAIL_QUARTERS = 0.25


# How many beats a measure has, and how many units of the metre each of them, by the metre's count.
# Other counts have a beat for every unit.
BEATS = {6: (2, 3), 9: (3, 3), 12: (4, 3), 24: (8, 3)}


def beat_strength(measure_onset: Column, ppq: Column, count: Column, unit: Column) -> Column:
    """1 on the downbeat; then 1/2 on the other beats of a triple measure and on the middle of an even one, 1/4 on the
    other beats, and half as much with each division of the beat, which is by three where beats are dotted. Null without a metre.

    6/8 has two beats of three eighths, 9/8 three, 12/8 four; the outer level of 12/8 and 4/4 is
    the half measure, of 9/8 and 3/4 the beat.
    """
    beats, units = count, F.lit(1)
    for name, (many, size) in BEATS.items():
        beats = F.when(count == name, many).otherwise(beats)
        units = F.when(count == name, size).otherwise(units)
    ticks = ppq * 4 / unit * units
    dotted = units == 3
    halves = (beats % 2 == 0) & (measure_onset * 2 == beats * ticks)
    thirds = beats % 3 == 0

    def on(division: Column) -> Column:
        return measure_onset * division % ticks == 0

    def divided(level: int) -> Column:
        return on(F.when(dotted, 3 * 2 ** (level - 1)).otherwise(2**level))

    beat = F.when((beats == 2) | thirds, 0.5).otherwise(0.25)
    return F.when(
        count.isNotNull() & unit.isNotNull(),
        F.when(measure_onset == 0, 1.0)
        .when(halves, 0.5)
        .when(on(F.lit(1)), beat)
        .when(divided(1), beat / 2)
        .when(divided(2), beat / 4)
        .otherwise(beat / 8),
    )


def seconds(quarters: Column, bpm: float) -> Column:
    return quarters * 60.0 / bpm
