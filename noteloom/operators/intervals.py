"""Melodic intervals within a part and harmonic intervals between parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import pitch
from noteloom.operators import dyadic
from noteloom.operators.notes import PART, beat, end_ppq
from noteloom.operators.ordered import BLOCK_ROWS, halo, neighbours, settle

# Width of the smallest time block in quarter notes: near the length of a note or two, so
# that a block holds few notes of each part and few notes span two blocks.
UNIT_QUARTERS = 2


def melodic_intervals(events: DataFrame, kind: str = "d", compound: bool = True,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Interval from the note before; ``Rest`` at a rest, nothing right after one."""
    window = neighbours(PART, "seq")
    told = settle(
        halo(events, "seq", before=1, size=block_rows).withColumns(
            {f"from_{c}": F.lag(c).over(window) for c in ("seq", "midi", "dpos")}
        )
    )
    rest = F.col("midi").isNull()
    follows_rest = F.col("from_midi").isNull() & F.col("from_seq").isNotNull()
    shown = told.filter((rest & ~follows_rest) | (~rest & F.col("from_midi").isNotNull()))
    return pitch.add_interval(shown, "step", kind, "from_", "", compound).select(
        "piece_id", "part", "measure", beat().alias("beat"), "onset_ppq",
        F.when(rest, F.lit("Rest")).otherwise(F.col("step")).alias("value"),
    )


def block_depth(events: DataFrame, quarters: int = UNIT_QUARTERS) -> int:
    """How many sizes of blocks the longest event is worth."""
    return dyadic.depth(events, F.col("dur_ppq") / (F.col("ppq") * quarters))


def time_blocks(events: DataFrame, quarters: int = UNIT_QUARTERS, deep: int | None = None) -> DataFrame:
    """Events of some length with a row for each ``block`` of time they sound or begin in (``dyadic.spread``)."""
    width = F.col("ppq") * quarters
    deep = block_depth(events, quarters) if deep is None else deep
    sounding = events.filter("dur_ppq > 0").withColumn("end_ppq", end_ppq())
    return dyadic.spread(sounding, F.floor(F.col("onset_ppq") / width), F.floor((F.col("end_ppq") - 1) / width), deep)


def sounding_pairs(
    events: DataFrame, columns: list[str], quarters: int = UNIT_QUARTERS, deep: int | None = None
) -> DataFrame:
    """Every pair of events of two parts that overlap, once, at the later onset.

    The later event begins while the earlier one sounds, so the pair meets in the one block of time that the
    earlier is cut into and the later begins in. However long the piece or its notes are, a key
    (piece, block) holds a bounded time. Of events that begin together the lower part counts as the later.
    """
    rows = time_blocks(events, quarters, deep)
    # Both sides carry the same columns and no condition is on one side alone, so that one shuffle can serve
    # both; the parts of a piece share its ppq.
    keys = ["piece_id", "block", "ppq"]
    role = F.when(F.col("covers"), 1).otherwise(0) + F.when(F.col("begins"), 2).otherwise(0)
    carried = ["part", "onset_ppq", "end_ppq", "measure", "measure_onset_ppq", *columns]

    def side(name: str) -> DataFrame:
        return rows.select(*keys, role.alias(f"{name}_role"), *[F.col(c).alias(f"{name}_{c}") for c in carried])

    # Blocks multiply rows in ways file sizes do not show, so neither side is
    # broadcast on the strength of its file.
    pairs = side("early").join(side("late").hint("merge"), keys).filter(
        (F.col("early_role").bitwiseAND(1) + F.col("late_role").bitwiseAND(2) == 3)
        & (F.col("early_part") != F.col("late_part"))
        & (F.col("late_onset_ppq") < F.col("early_end_ppq"))
        & (F.col("early_onset_ppq") < F.col("late_end_ppq"))
        & (
            (F.col("early_onset_ppq") < F.col("late_onset_ppq"))
            | ((F.col("early_onset_ppq") == F.col("late_onset_ppq")) & (F.col("early_part") < F.col("late_part")))
        )
    )
    lower = F.col("late_part") > F.col("early_part")
    later = F.col("late_onset_ppq") >= F.col("early_onset_ppq")
    return pairs.select(
        *keys,
        *[F.when(lower, F.col(f"late_{c}")).otherwise(F.col(f"early_{c}")).alias(f"low_{c}") for c in carried],
        *[F.when(lower, F.col(f"early_{c}")).otherwise(F.col(f"late_{c}")).alias(f"high_{c}") for c in carried],
        F.greatest("early_onset_ppq", "late_onset_ppq").alias("onset_ppq"),
        *[F.when(later, F.col(f"late_{c}")).otherwise(F.col(f"early_{c}")).alias(c) for c in ("measure", "measure_onset_ppq")],
    )


def voice_pair() -> Column:
    return F.concat_ws("_", "low_part", "high_part")


def harmonic_intervals(events: DataFrame, kind: str = "q", compound: bool = True) -> DataFrame:
    """Interval from the lower to the upper part wherever one of the two moves."""
    pairs = sounding_pairs(events, ["midi", "dpos"])
    return pitch.add_interval(pairs, "token", kind, "low_", "high_", compound).select(
        "piece_id",
        voice_pair().alias("voice_pair"),
        "measure",
        beat().alias("beat"),
        "onset_ppq",
        F.coalesce("token", F.lit("Rest")).alias("value"),
    )
