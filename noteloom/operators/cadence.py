"""Cadences by a table of two-voice formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import pitch
from noteloom.operators.intervals import block_depth, sounding_pairs
from noteloom.operators.notes import PART
from noteloom.operators.ordered import BLOCK_ROWS, halo, neighbours, settle

# The formulas of two voices closing on a unison or octave.
# rank, step of the lower voice, number above it before the close, step of the
# upper voice, whether the close is phrygian, dissonance that prepares it and the
# voice that holds it, functions of the lower and the upper voice, cadence type.
RULES = [
    (1, "4", "3", "2", False, "4", "high", "B", "Ct", "Authentic"),
    (1, "-5", "3", "2", False, "4", "high", "B", "Ct", "Authentic"),
    (2, "-2", "6", "2", True, "7", "high", "T", "Ct", "Phrygian"),
    (3, "-2", "6", "2", False, "7", "high", "T", "Ct", "Clausula Vera"),
    (4, "2", "3", "-2", False, "2", "low", "Ct", "T", "Clausula Vera"),
    (5, "5", "5", "1", False, None, None, "B", "Ct", "Plagal"),
    (5, "-4", "5", "1", False, None, None, "B", "Ct", "Plagal"),
]
RULE_SCHEMA = (
    "rank int, low_step string, number string, high_step string, phrygian boolean,"
    " prepared_by string, holder string, low_function string, high_function string, cad_type string"
)
EVADED = (9, "Evaded")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def cadence_formulas(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every pair of voices whose motion fits a rule, at the onset it closes on.

    Each note first learns its neighbours in its own part; the pair before and
    after then follow from the pair itself, so pairs are never put in order. A prepared dissonance whose
    close does not come, because a voice goes elsewhere or rests, is evaded.
    """
    window = neighbours(PART, "seq")
    near = {
        "next_midi": F.lead("midi"),
        "next_dpos": F.lead("dpos"),
        "next_measure": F.lead("measure"),
        "next_measure_onset": F.lead("measure_onset_ppq"),
        "prev_midi": F.lag("midi"),
        "prev_dpos": F.lag("dpos"),
    }
    told = settle(
        halo(events, "seq", before=1, after=1, size=block_rows).withColumns(
            {name: col.over(window) for name, col in near.items()}
        )
    )
    sounding = told.filter("midi is not null")
    pairs = sounding_pairs(sounding, ["midi", "dpos", *near], deep=block_depth(events)).filter(
        "low_next_measure is not null and low_end_ppq <= high_end_ppq"
    )

    moves = F.col("high_end_ppq") == F.col("low_end_ppq")
    goal = pairs.withColumns(
        {
            "goal_high_midi": F.when(moves, F.col("high_next_midi")).otherwise(F.col("high_midi")),
            "goal_high_dpos": F.when(moves, F.col("high_next_dpos")).otherwise(F.col("high_dpos")),
        }
    )

    def number(low: str, high: str) -> Column:
        return pitch.interval(
            "d", F.col(f"{low}_midi"), F.col(f"{low}_dpos"), F.col(f"{high}_midi"), F.col(f"{high}_dpos"), False
        )

    def step(from_: str, to: str) -> Column:
        return pitch.interval("d", F.col(f"{from_}_midi"), F.col(f"{from_}_dpos"), F.col(f"{to}_midi"), F.col(f"{to}_dpos"))

    measured = goal.select(
        "piece_id",
        "low_part",
        "high_part",
        F.col("low_end_ppq").alias("onset_ppq"),
        "ppq",
        F.col("low_next_measure").alias("measure"),
        F.col("low_next_measure_onset").alias("measure_onset_ppq"),
        step("low", "low_next").alias("low_step"),
        number("low", "high").alias("number"),
        step("high", "goal_high").alias("high_step"),
        number("low_next", "goal_high").alias("goal"),
        (
            (F.col("low_next_midi") - F.col("low_midi") == -1)
            & (F.pmod(F.col("high_midi") - F.col("low_midi"), F.lit(12)) == 9)
        ).alias("phrygian"),
        F.when(
            (F.col("high_onset_ppq") > F.col("low_onset_ppq")) & (step("high_prev", "high") == "-2"),
            number("low", "high_prev"),
        ).alias("held_high"),
        F.when(
            (F.col("low_onset_ppq") > F.col("high_onset_ppq")) & (step("low_prev", "low") == "-2"),
            number("low_prev", "high"),
        ).alias("held_low"),
        F.least("low_next_midi", "goal_high_midi").alias("tone_midi"),
        F.col("low_next_midi").isNull().alias("low_rests"),
    )
    rules = F.broadcast(rule_table(events.sparkSession)).alias("r")
    # A lower voice that falls silent fits each formula by what is held above it; one step stands for the formula.
    silent = F.col("low_rests") & F.col("low_step").isin("4", "-2", "2")
    fits = measured.withColumnRenamed("low_step", "moved").alias("m").join(
        rules, (F.col("m.number") == F.col("r.number")) & ((F.col("moved") == F.col("low_step")) | silent)
    )
    prepared = F.coalesce(
        F.when(F.col("holder") == "high", F.col("held_high") == F.col("prepared_by")).when(
            F.col("holder") == "low", F.col("held_low") == F.col("prepared_by")
        ),
        F.lit(False),
    )
    reached = F.coalesce(F.col("goal") == "1", F.lit(False))
    closes = (
        reached
        & (F.col("m.high_step") == F.col("r.high_step"))
        & ((F.col("low_step") != "-2") | (F.col("m.phrygian") == F.col("r.phrygian")))
    )
    evaded = prepared & ~reached & ~F.col("r.phrygian")
    return fits.filter(F.coalesce(closes, F.lit(False)) | evaded).select(
        "piece_id",
        "low_part",
        "high_part",
        "onset_ppq",
        "ppq",
        "measure",
        "measure_onset_ppq",
        F.when(reached, F.col("rank")).otherwise(F.lit(EVADED[0])).alias("rank"),
        F.when(reached, F.col("cad_type")).otherwise(F.lit(EVADED[1])).alias("cad_type"),
        "low_function",
        "high_function",
        "tone_midi",
        (prepared & reached).alias("suspended"),
    )


def cadences(events: DataFrame, metadata: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per onset where voices close: type, tone, and voice functions.

    When several pairs close together the formula of the lowest rank names the
    cadence, and every voice that takes part is listed, top part first.
    """
    formulas = cadence_formulas(events, block_rows)
    functions = F.array_sort(
        F.array_union(
            F.collect_set(F.struct(F.col("high_part").alias("part"), F.col("high_function").alias("function"))),
            F.collect_set(F.struct(F.col("low_part").alias("part"), F.col("low_function").alias("function"))),
        )
    )
    closes = formulas.groupBy("piece_id", "onset_ppq").agg(
        F.min("ppq").alias("ppq"),
        F.min("measure").alias("measure"),
        F.min("measure_onset_ppq").alias("measure_onset_ppq"),
        F.min_by("cad_type", "rank").alias("cad_type"),
        F.min("tone_midi").alias("tone_midi"),
        F.transform(functions, lambda v: v["function"]).alias("cvfs"),
    )
    ends = events.groupBy("piece_id").agg(F.max(F.col("onset_ppq") + F.col("dur_ppq")).alias("end_ppq"))
    return (
        closes.join(ends, "piece_id")
        .join(metadata.select("piece_id", "composer", "title"), "piece_id", "left")
        .select(
            "piece_id",
            "composer",
            "title",
            "measure",
            (1 + F.col("measure_onset_ppq") / F.col("ppq")).alias("beat"),
            "onset_ppq",
            (F.col("onset_ppq") / F.col("end_ppq")).alias("progress"),
            "cad_type",
            pitch.pitch_class_name(pitch.pitch_class(F.col("tone_midi"))).alias("tone"),
            "cvfs",
        )
    )
