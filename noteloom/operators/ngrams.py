"""Melodic n-grams: occurrences, entries, counts, first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import pitch
from noteloom.operators.notes import PART, beat, combine, end_ppq
from noteloom.operators.ordered import BLOCK_ROWS, halo, neighbours, settle


def melodic_ngrams(
    events: DataFrame,
    n: int = 4,
    kind: str = "d",
    entries: bool = False,
    combine_unisons: bool | None = None,
    compound: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Runs of ``n`` melodic intervals, placed at their first note.

    A run never crosses a rest. With ``entries`` only runs stay whose first note
    opens the part or a section, or follows a rest or a fermata. ``note_ids`` are
    the ids of the n+1 notes; ``end_ppq`` is where the last of them ends.
    """
    if n < 1:
        raise ValueError(f"an n-gram has one interval or more, not {n}")
    if combine_unisons:
        events = combine(events, unisons=True, block_rows=block_rows)

    window = neighbours(PART, "seq")
    rows = halo(events, "seq", before=1 if entries else 0, after=n, size=block_rows)
    if entries:
        # What came before the note: nothing, a rest, or a held fermata.
        opens = (
            F.lag("seq").over(window).isNull()
            | F.lag("midi").over(window).isNull()
            | F.coalesce(F.lag("fermata").over(window), F.lit(False))
            | F.col("section_start")
        )
        rows = rows.withColumn("opens", opens)
    rows = rows.withColumns({f"to_{c}": F.lead(c).over(window) for c in ("midi", "dpos")})
    rows = pitch.add_interval(rows, "step", kind, "", "to_", compound)
    steps = [F.col("step"), *[F.lead("step", k).over(window) for k in range(1, n)]]
    pattern = F.concat(*[piece for s in steps for piece in (F.lit("_"), s)][1:])
    rows = rows.withColumns(
        {
            "pattern_string": pattern,
            "end_ppq": F.lead(end_ppq(), n).over(window),
            "ids": F.flatten(F.collect_list("note_ids").over(window.rowsBetween(0, n))),
        }
    )
    found = settle(rows).filter("pattern_string is not null")
    if entries:
        found = found.filter("opens")
    return found.select(
        "piece_id",
        "part",
        "seq",
        "measure",
        beat().alias("beat"),
        "onset_ppq",
        "ppq",
        F.split("pattern_string", "_").alias("pattern"),
        "pattern_string",
        (F.col("end_ppq") - F.col("onset_ppq")).alias("dur_ppq"),
        "end_ppq",
        F.col("ids").alias("note_ids"),
    )


def count_patterns(ngrams: DataFrame, ordered: bool = False) -> DataFrame:
    """Occurrences per piece and pattern; ``ordered`` puts the most frequent first within a piece."""
    counts = ngrams.groupBy("piece_id", "pattern_string").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("piece_id", F.desc("count"), "pattern_string") if ordered else counts


def keep_patterns(ngrams: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Only the named patterns; an empty or blank list keeps everything."""
    names = [p.strip() for p in wanted or [] if p.strip()]
    return ngrams.filter(F.col("pattern_string").isin(names)) if names else ngrams


def matches(ngrams: DataFrame, wanted: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """Occurrence records; ``ordered`` sorts them by pattern and place for display."""
    found = keep_patterns(ngrams, wanted).select(
        "piece_id",
        "pattern_string",
        "part",
        "measure",
        "beat",
        "onset_ppq",
        "dur_ppq",
        "end_ppq",
        "note_ids",
    )
    return found.orderBy("piece_id", "pattern_string", "onset_ppq", "part") if ordered else found


def first_occurrences(ngrams: DataFrame, ordered: bool = False) -> DataFrame:
    """Earliest occurrence of every pattern of a piece, with its total count; ``ordered`` sorts them by place.

    Count and earliest place come from one aggregation, so a pattern that fills
    the corpus is reduced before the shuffle.
    """
    place = F.struct("onset_ppq", "part")
    firsts = ngrams.groupBy("piece_id", "pattern_string").agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by(F.struct("part", "onset_ppq", "dur_ppq", "end_ppq", "ppq", "note_ids"), place).alias("first"),
    )
    found = firsts.select(
        "piece_id",
        "pattern_string",
        "count",
        (F.col("first.onset_ppq") / F.col("first.ppq")).alias("start_q"),
        (F.col("first.dur_ppq") / F.col("first.ppq")).alias("duration"),
        (F.col("first.end_ppq") / F.col("first.ppq")).alias("end_q"),
        F.col("first.part").alias("part"),
        F.col("first.note_ids").alias("note_ids"),
    )
    return found.orderBy("piece_id", "start_q", F.col("part").cast("string"), "pattern_string") if ordered else found
