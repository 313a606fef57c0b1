"""From analysis locations and ranges to the ids of the notes found there.

A span names a piece and a location (measure and beat, or a quarter offset). It
asks for a number of consecutive notes (``note_count``), for the notes that begin
in a range (``end_q`` or ``duration``), or for the notes at the location itself.
Nothing is looked up by scanning a piece: spans and notes meet in aligned blocks of
time, or of note numbers, of one piece (``dyadic``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import patterns
from noteloom.operators import dyadic
from noteloom.operators.notes import PART, beat

UNIT_Q = 4
UNIT_NOTES = 64

SPAN_FIELDS = {
    "start_measure": "double",
    "start_beat": "double",
    "start_q": "double",
    "start_offset": "double",
    "end_q": "double",
    "end_offset": "double",
    "duration": "double",
    "note_count": "int",
    "column": "string",
    "staff": "string",
    "part": "string",
    "voice_pair": "string",
}


def note_index(events: DataFrame) -> DataFrame:
    """Sounding events with their number in the part and comparable locations."""
    return events.filter("note_place is not null").select(
        *PART,
        F.col("note_place").alias("place"),
        patterns.location(F.col("measure")).alias("at_measure"),
        patterns.location(beat()).alias("at_beat"),
        patterns.location(F.col("onset_ppq") / F.col("ppq")).alias("at_q"),
        "note_ids",
    )


def _requests(spans: DataFrame) -> DataFrame:
    """Spans with one start, one end and a part list, whatever fields they use."""
    given = spans.select(
        "piece_id",
        "index",
        *[
            (F.col(name) if name in spans.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in SPAN_FIELDS.items()
        ],
    )
    start = F.coalesce("start_q", "start_offset")
    labels = F.coalesce("column", "staff", "part", "voice_pair")
    return given.select(
        "piece_id",
        "index",
        patterns.location(F.col("start_measure")).alias("s_measure"),
        patterns.location(F.col("start_beat")).alias("s_beat"),
        patterns.location(start).alias("s_q"),
        patterns.location(F.coalesce(F.col("end_q"), F.col("end_offset"), start + F.col("duration"))).alias("e_q"),
        "note_count",
        F.when(F.size(patterns.part_labels(labels)) > 0, patterns.part_labels(labels)).alias("wanted"),
    )


def _asked(part: Column) -> Column:
    return F.col("wanted").isNull() | F.array_contains("wanted", part.cast("string"))


def _unit_q(q: Column) -> Column:
    return F.floor(q / UNIT_Q)


def _in_range(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that begin in [start, end), or exactly at the start when no end is given."""
    ends = notes.groupBy("piece_id").agg(F.max("at_q").alias("last_q"))
    timed = requests.filter("note_count is null and s_q is not null").join(ends, "piece_id").filter("s_q <= last_q")
    # No further than the last note of the piece, however far the request goes.
    last = F.coalesce(F.when(F.col("e_q") > F.col("s_q"), F.least("e_q", "last_q")), F.col("s_q"))
    deep = dyadic.depth(requests, (F.col("e_q") - F.col("s_q")) / UNIT_Q)
    found = dyadic.meet(timed, _unit_q(F.col("s_q")), _unit_q(last), notes, _unit_q(F.col("at_q")), ["piece_id"], deep)
    inside = F.when(F.col("e_q").isNull(), F.col("at_q") == F.col("s_q")).otherwise(
        (F.col("at_q") >= F.col("s_q")) & (F.col("at_q") < F.col("e_q"))
    )
    return found.filter(inside & _asked(F.col("part")))


def _at_beat(requests: DataFrame, notes: DataFrame) -> DataFrame:
    placed = requests.filter("note_count is null and s_q is null")
    return _meet_at_beat(placed, notes).filter(_asked(F.col("part")))


def _meet_at_beat(requests: DataFrame, notes: DataFrame) -> DataFrame:
    keyed = requests.withColumns({"at_measure": F.col("s_measure"), "at_beat": F.col("s_beat")})
    return keyed.join(notes, ["piece_id", "at_measure", "at_beat"])


def start_notes(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """The note each counted span starts at, per part.

    Tried in this order: measure, beat and offset agree; the offset agrees;
    measure and beat agree. The first note wins within each.
    """
    counted = requests.filter("note_count is not null")
    by_offset = counted.filter("s_q is not null").withColumn("at_q", F.col("s_q")).join(notes, ["piece_id", "at_q"])
    exact = F.coalesce(
        (F.col("s_measure") == F.col("at_measure")) & (F.col("s_beat") == F.col("at_beat")), F.lit(False)
    )
    by_offset = by_offset.withColumn("choice", F.when(exact, 0).otherwise(1))
    # Only the first note of a part at a place can win, so measures that share a number cost one row.
    here = ["piece_id", "at_measure", "at_beat", "part"]
    firsts = notes.groupBy(*here).agg(F.min_by(F.struct("at_q", "note_ids"), "place").alias("first"), F.min("place").alias("place"))
    firsts = firsts.select(*here, "place", "first.*")
    by_beat = _meet_at_beat(counted, firsts).withColumn("choice", F.lit(2))
    candidates = by_offset.unionByName(by_beat).filter(_asked(F.col("part")))
    first = F.min(F.struct("choice", "place")).alias("best")
    return candidates.groupBy("piece_id", "index", "part", "note_count", "wanted").agg(first).select(
        "piece_id", "index", "part", "note_count", "wanted", F.col("best.place").alias("from_place")
    )


def _counted(requests: DataFrame, notes: DataFrame) -> DataFrame:
    starts = start_notes(requests, notes).filter("note_count > 0")
    counted = starts.withColumn("until", F.col("from_place") + F.col("note_count"))
    first, last = (F.floor(c / UNIT_NOTES) for c in (F.col("from_place"), F.col("until") - 1))
    deep = dyadic.depth(requests, F.col("note_count") / UNIT_NOTES)
    found = dyadic.meet(counted, first, last, notes, F.floor(F.col("place") / UNIT_NOTES), PART, deep)
    return found.filter("place >= from_place and place < until")


def resolve(events: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per span and note it matches, in long form: any span length works."""
    notes = note_index(events)
    requests = _requests(spans)
    columns = ["piece_id", "index", "part", "place", "wanted", "note_ids"]
    found = (
        _in_range(requests, notes).select(*columns)
        .unionByName(_at_beat(requests, notes).select(*columns))
        .unionByName(_counted(requests, notes).select(*columns))
    )
    # Parts come in the order they were asked for, else in part order.
    asked_at = F.array_position("wanted", F.col("part").cast("string"))
    return found.select(
        "piece_id", "index", "part", "place", F.coalesce(asked_at, F.col("part")).alias("part_order"), "note_ids"
    )


def resolve_spans(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with their matched parts and note ids; spans without a match stay.

    Each row lists all ids of its span. ``resolve`` gives the same notes one per
    row, for spans as long as a piece.
    """
    found = resolve(events, spans)
    listed = F.array_sort(F.collect_list(F.struct("part_order", "place", "part", "note_ids")))
    gathered = found.groupBy("piece_id", "index").agg(listed.alias("hits"))
    none = F.array().cast("array<string>")
    return spans.join(gathered, ["piece_id", "index"], "left").select(
        *spans.columns,
        F.coalesce(
            F.array_distinct(F.transform("hits", lambda h: h["part"].cast("string"))), none
        ).alias("matched_parts"),
        F.coalesce(F.flatten(F.transform("hits", lambda h: h["note_ids"])), none).alias("note_ids"),
    )
