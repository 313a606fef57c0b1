"""The most frequent melodic n-grams of a corpus on a timeline per part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import patterns
from noteloom.operators.notes import end_ppq

# The number of distinct pattern colours a timeline cycles through.
COLOURS = 8

# A timeline shows so many patterns at most; the table of them is then small enough to broadcast.
MOST = 10_000


def top_patterns(ngrams: DataFrame, top_n: int = 2) -> DataFrame:
    """The ``top_n`` most frequent patterns over all pieces, with a colour slot."""
    if not 1 <= top_n <= MOST:
        raise ValueError(f"between 1 and {MOST} patterns can be shown, not {top_n}")
    counts = ngrams.groupBy("pattern_string").agg(F.count(F.lit(1)).alias("count"))
    best = counts.orderBy(F.desc("count"), "pattern_string").limit(top_n)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "pattern_string"))
    return best.select("pattern_string", "count", F.pmod(rank - 1, F.lit(COLOURS)).alias("colour"))


def occurrences(ngrams: DataFrame, top_n: int = 2) -> DataFrame:
    """Every occurrence of the top patterns that lasts.

    The joined side has ``top_n`` rows, at most ``MOST``, so it is broadcast.
    """
    chosen = F.broadcast(top_patterns(ngrams, top_n).select("pattern_string", "colour"))
    start = F.col("onset_ppq") / F.col("ppq")
    return ngrams.filter("dur_ppq > 0").join(chosen, "pattern_string").select(
        patterns.row_id(F.col("piece_id"), F.col("part"), F.col("pattern_string"), start).alias("id"),
        patterns.row_id(F.col("piece_id"), F.col("part")).alias("row_id"),
        "piece_id",
        "part",
        "pattern_string",
        start.alias("start_q"),
        (F.col("end_ppq") / F.col("ppq")).alias("end_q"),
        (F.col("dur_ppq") / F.col("ppq")).alias("duration"),
        "measure",
        "beat",
        "note_ids",
        "colour",
    )


def timeline_rows(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per part: its label and where its last note ends."""
    ends = events.groupBy("piece_id", "part").agg(
        F.coalesce(F.max(F.when(F.col("midi").isNotNull(), end_ppq() / F.col("ppq"))), F.lit(0.0)).alias("end_q")
    )
    label = patterns.score_label(F.col("title"), F.col("piece_id"))
    return ends.join(metadata.select("piece_id", "title"), "piece_id", "left").select(
        patterns.row_id(F.col("piece_id"), F.col("part")).alias("id"),
        "piece_id",
        "part",
        F.concat(label, F.lit(" - Staff "), F.col("part")).alias("label"),
        "end_q",
    )


def time_axis(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The end of the common time axis; 0 when there is nothing to show."""
    ends = rows.agg(F.max("end_q").alias("end_q")).unionByName(found.agg(F.max("end_q").alias("end_q")))
    return ends.agg(F.coalesce(F.max("end_q"), F.lit(0.0)).alias("x_max"))
