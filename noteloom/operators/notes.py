"""The note table, and merging of ties, rests and repeated pitches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import pitch
from noteloom.operators.ordered import BLOCK_ROWS, block_of, halo, neighbours, running, settle

PART = ["piece_id", "part"]


def end_ppq() -> Column:
    return F.col("onset_ppq") + F.col("dur_ppq")


def beat() -> Column:
    return 1 + F.col("measure_onset_ppq") / F.col("ppq")


def _run_starts(events: DataFrame, unisons: bool, block_rows: int) -> DataFrame:
    """Flag each event that is not a continuation of a rest (or of a unison)."""
    edge = halo(events, "seq", before=1, size=block_rows)
    window = neighbours(PART, "seq")
    previous = F.lag("midi").over(window)
    first = F.lag("seq").over(window).isNull()
    same = previous.isNull() & F.col("midi").isNull()
    if unisons:
        same = same | (previous == F.col("midi"))
    return settle(edge.withColumn("starts", first | ~F.coalesce(same, F.lit(False))), keep_block=True)


def note_table(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pitch or ``Rest`` at every onset of every part; consecutive rests are one."""
    kept = _run_starts(events, False, block_rows).filter("starts")
    return kept.select(
        "piece_id",
        "part",
        "measure",
        beat().alias("beat"),
        "onset_ppq",
        F.coalesce(pitch.midi_to_name(F.col("midi")), F.lit("Rest")).alias("token"),
    )


def combine(events: DataFrame, unisons: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merge consecutive rests, and repeated pitches when ``unisons``.

    A merged event keeps the place and ids of its first member and lasts until
    the next one starts; ``seq`` counts the merged events without gaps.
    """
    flagged = _run_starts(events, unisons, block_rows)
    placed = running(
        flagged,
        PART,
        ["seq"],
        None,
        sums={
            "run": F.col("starts").cast("bigint"),
            "notes_before": (F.col("starts") & F.col("midi").isNotNull()).cast("bigint"),
        },
        nexts={"next_onset": F.when(F.col("starts"), F.col("onset_ppq"))},
        totals={"part_end": ("max", end_ppq())},
    )
    merged = placed.filter("starts").withColumns(
        {
            "seq": F.col("run") + 1,
            "note_place": F.when(F.col("midi").isNotNull(), F.col("notes_before")),
            "dur_ppq": F.coalesce("next_onset", "part_end") - F.col("onset_ppq"),
        }
    )
    return merged.select(*events.columns)


def merge_ties(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join every note to the tied notes that follow it (``tied_from_prev``).

    The merged note has the summed duration and the ids of all its members.
    """
    head = ~F.col("tied_from_prev")
    counted = running(
        events.drop("note_place"), PART, ["seq"], block_of("seq", block_rows),
        sums={
            "heads": head.cast("bigint"),
            "note_place": (head & F.col("midi").isNotNull()).cast("bigint"),
        },
    )
    # The head is the first row of its chain, so it opens a new run itself.
    counted = counted.withColumns({
        "run": F.col("heads") + head.cast("bigint"),
        "note_place": F.when(F.col("midi").isNotNull(), F.col("note_place")),
    })
    dropped = (*PART, "seq", "dur_ppq", "note_ids", "tied_from_prev", "heads", "run")
    kept = [c for c in counted.columns if c not in dropped]
    merged = counted.groupBy(*PART, "run").agg(
        F.sum("dur_ppq").alias("dur_ppq"),
        F.min_by(F.struct(*kept), "seq").alias("head"),
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "note_ids"))), lambda x: x["note_ids"])
        ).alias("note_ids"),
    )
    return merged.select(*PART, F.col("run").alias("seq"), "dur_ppq", "note_ids", "head.*")
