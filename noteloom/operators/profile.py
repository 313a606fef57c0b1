"""One summary row per piece."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators import cadence, distribution, intervals, ngrams


def _most_common(table: DataFrame, column: str, alias: str) -> DataFrame:
    """The most frequent value per piece, ties to the smaller value."""
    counts = table.groupBy("piece_id", column).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("piece_id").agg(F.min(F.struct((-F.col("n")).alias("rank"), column)).alias("best"))
    return best.select("piece_id", F.col(f"best.{column}").alias(alias), (-F.col("best.rank")).alias(f"{alias}_count"))


def piece_profile(events: DataFrame, metadata: DataFrame, n: int = 4) -> DataFrame:
    """Header, key, size, leading n-gram and harmony, and cadences of every piece.

    Every part is reduced to one row per piece before the parts are joined.
    """
    size = events.groupBy("piece_id").agg(
        F.count("midi").alias("notes"), F.count_distinct("part").alias("parts")
    )
    pattern = _most_common(ngrams.melodic_ngrams(events, n), "pattern_string", "top_pattern")
    # Without the rests up front, so that no token is made just to be dropped.
    sounding = intervals.harmonic_intervals(events.filter("midi is not null"))
    harmony = _most_common(sounding, "value", "top_harmony")
    closes = cadence.cadence_formulas(events).groupBy("piece_id").agg(
        F.count_distinct("onset_ppq").alias("cadences")
    )
    return (
        size.join(metadata.select("piece_id", "title", "composer"), "piece_id", "left")
        .join(distribution.keys_of(events), "piece_id", "left")
        .join(pattern, "piece_id", "left")
        .join(harmony, "piece_id", "left")
        .join(closes, "piece_id", "left")
        .withColumn("cadences", F.coalesce("cadences", F.lit(0)))
    )
