"""Measure ranges and timed excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import metre, pitch


def measure_range(events: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """Events of the measures from ``start`` to ``end``; one measure without ``end``."""
    return events.filter(F.col("measure").between(float(start), float(start if end is None else end)))


def piece_ends(events: DataFrame) -> DataFrame:
    return events.groupBy("piece_id").agg(
        F.max((F.col("onset_ppq") + F.col("dur_ppq")) / F.col("ppq")).alias("end_q")
    )


def _checked(start_q: float, end_q: float | None, bpm: float) -> None:
    """Tempo above zero, and times in order from zero on."""
    times = [0.0, start_q] + ([] if end_q is None else [end_q])
    if not bpm > 0:
        raise ValueError(f"a tempo of {bpm} beats a minute")
    if times != sorted(times) or end_q == start_q:
        raise ValueError(f"an excerpt from {start_q} to {end_q} quarters")


def excerpt_bounds(events: DataFrame, start_q: float = 0.0, end_q: float | None = None, bpm: float = 60) -> DataFrame:
    """Start and end of the excerpt of every piece in seconds, inside the piece.

    Pieces that end before the excerpt starts give no row.
    """
    _checked(start_q, end_q, bpm)
    length = metre.seconds(F.col("end_q"), bpm)
    until = length if end_q is None else metre.seconds(F.lit(end_q + metre.TAIL_QUARTERS), bpm)
    start = F.least(metre.seconds(F.lit(float(start_q)), bpm), length)
    return (
        piece_ends(events)
        .select("piece_id", start.alias("start_sec"), F.least(until, length).alias("end_sec"))
        .filter("end_sec > start_sec")
        .withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))
    )


def excerpt(events: DataFrame, start_q: float = 0.0, end_q: float | None = None, bpm: float = 60) -> DataFrame:
    """Notes that begin in the excerpt, timed from its start, with audible velocities.

    A note that already sounds when the excerpt starts is no part of it; a sound file cut there would hold its rest.
    """
    _checked(start_q, end_q, bpm)
    onset = F.col("onset_ppq") / F.col("ppq")
    inside = onset >= start_q
    if end_q is not None:
        inside = inside & (onset < end_q + metre.TAIL_QUARTERS)
    notes = events.filter(inside).select("*", F.explode("pitches").alias("note"))
    return notes.select(
        "piece_id",
        "part",
        "onset_ppq",
        F.col("note.midi").alias("midi"),
        pitch.audible_velocity(F.col("note.vel")).alias("velocity"),
        metre.seconds(onset - start_q, bpm).alias("at_sec"),
        metre.seconds(F.col("dur_ppq") / F.col("ppq"), bpm).alias("for_sec"),
    )
