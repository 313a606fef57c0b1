"""Duration-weighted pitch classes, key finding and voice ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import patterns, pitch

# Published key profiles, from the tonic upwards.
KEY_PROFILES = {
    "krumhansl": {
        "major": [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88],
        "minor": [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17],
    },
    "aarden": {
        "major": [17.7661, 0.145624, 14.9265, 0.160186, 19.8049, 11.3587, 0.291248, 22.062, 0.145624, 8.15494,
                  0.232998, 4.95122],
        "minor": [18.2648, 0.737619, 14.0499, 16.8599, 0.702494, 14.4362, 0.702494, 18.6161, 4.56621, 1.93186,
                  7.37619, 1.75623],
    },
}

PITCH_CLASSES = range(12)


def sounding_notes(events: DataFrame) -> DataFrame:
    """One row per pitch, chord notes apart; rests give none."""
    return events.select("piece_id", "part", "staff", "dur_ppq", F.explode("pitches").alias("note")).select(
        "piece_id", "part", "staff", "dur_ppq", "note.*"
    )


def pitch_class_totals(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of the twelve pitch classes side by side: ``w0`` .. ``w11``.

    A single aggregation with flat buffers; each task reduces its rows to one
    row per key before anything is shuffled.
    """
    return notes.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("pc") == k, F.col("dur_ppq")).otherwise(F.lit(0))).cast("bigint").alias(f"w{k}")
            for k in PITCH_CLASSES
        ],
        F.count(F.lit(1)).alias("note_count"),
    )


def weighted_distribution(
    events: DataFrame,
    by_staff: bool = False,
    order: str = "fifths",
    limit_to_active: bool = True,
    written: bool = False,
) -> DataFrame:
    """Share of each pitch class in a piece (or staff), weighted by duration.

    ``written`` takes the accidental printed at the note instead of the sounding one.
    """
    position = pitch.order_position(F.col("pc"), order)
    keys = ["piece_id", "staff"] if by_staff else ["piece_id"]
    notes = sounding_notes(events)
    if written:
        notes = notes.withColumn("pc", F.col("written_pc"))
    totals = pitch_class_totals(notes, keys)
    total = sum((F.col(f"w{k}") for k in PITCH_CLASSES[1:]), F.col("w0"))
    grid = totals.withColumn("total", total).select(
        *keys, "total", "note_count", F.posexplode(F.array(*[f"w{k}" for k in PITCH_CLASSES])).alias("pc", "weight_ppq")
    )
    if limit_to_active:
        # From the totals, not from the notes again: at most twelve rows, whatever the size of the corpus.
        largest = totals.agg(*[F.max(f"w{k}").alias(f"w{k}") for k in PITCH_CLASSES])
        active = largest.select(F.posexplode(F.array(*[f"w{k}" for k in PITCH_CLASSES])).alias("pc", "largest"))
        active = active.filter("largest > 0").select("pc")
        grid = grid.join(F.broadcast(active), "pc", "left_semi")
    return grid.select(
        *keys,
        pitch.pitch_class_name(F.col("pc")).alias("pc_label"),
        position.cast("int").alias("position"),
        "weight_ppq",
        F.when(F.col("total") > 0, F.col("weight_ppq") / F.col("total")).otherwise(F.lit(0.0)).alias("share"),
        "note_count",
    )


def distribution_summary(distribution: DataFrame, metadata: DataFrame) -> DataFrame:
    """Number of scores, largest share and the composers of a comparison."""
    pieces = distribution.groupBy("piece_id").agg(F.max("share").alias("largest"))
    named = pieces.join(metadata.select("piece_id", "composer"), "piece_id", "left")
    return named.agg(
        F.count(F.lit(1)).alias("score_count"),
        F.max("largest").alias("radial_max"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("composer") != "", F.col("composer")))), ", ").alias(
            "composer"
        ),
    )


def traces(distribution: DataFrame, metadata: DataFrame) -> DataFrame:
    """Label and id of every trace of a distribution plot."""
    keys = [c for c in ("piece_id", "staff") if c in distribution.columns]
    named = distribution.select(*keys, "note_count").distinct().join(
        metadata.select("piece_id", "title"), "piece_id", "left"
    )
    label = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("piece_id"))
    if "staff" in keys:
        label = F.concat(label, F.lit(" - Staff "), F.col("staff"))
    return named.select(*keys, label.alias("label"), patterns.trace_id(label).alias("trace_id"), "note_count")


def _centred(profile: list[float]) -> list[float]:
    mean = sum(profile) / 12
    size = math.sqrt(sum((p - mean) ** 2 for p in profile))
    return [(p - mean) / size for p in profile]


def keys_of(events: DataFrame, profile: str = "aarden") -> DataFrame:
    """Best key of every piece and its correlation with the key's profile.

    Each correlation is a weighted sum of the twelve totals with constants known
    when the plan is built, so nothing is joined or exploded.
    """
    totals = pitch_class_totals(sounding_notes(events), ["piece_id"])
    weights = [F.col(f"w{k}").cast("double") for k in PITCH_CLASSES]
    total = sum(weights[1:], weights[0])
    spread = sum((w * w for w in weights[1:]), weights[0] * weights[0]) - total * total / 12
    candidates = []
    for index, (mode, tonic) in enumerate((m, t) for m in ("major", "minor") for t in PITCH_CLASSES):
        shape = _centred(KEY_PROFILES[profile][mode])
        terms = [weights[k] * shape[(k - tonic) % 12] for k in PITCH_CLASSES]
        name = pitch.PITCH_CLASS_NAMES[tonic]
        candidates.append(
            F.struct(
                (sum(terms[1:], terms[0]) / F.sqrt(F.col("spread"))).alias("r"),
                F.lit(-index).alias("first_wins"),
                F.lit(f"{name if mode == 'major' else name.lower()} {mode}").alias("key_name"),
            )
        )
    best = totals.withColumn("spread", spread).filter("spread > 0").select(
        "piece_id", F.array_max(F.array(*candidates)).alias("best")
    )
    return best.select("piece_id", "best.key_name", F.col("best.r").alias("confidence"))


def key_distribution(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key_name").agg(F.count(F.lit(1)).alias("pieces")).orderBy(F.desc("pieces"), "key_name")


def ranges_of_tokens(cells: DataFrame, rest: str = "Rest") -> tuple[DataFrame, DataFrame]:
    """Voice ranges of written pitches, and the tokens that are none.

    ``cells`` has ``piece_id``, ``part`` and ``token``, as ``notes.note_table`` gives them or a note table that was
    read from a file. Null cells and rests are silent. One bad token stops nothing: the ranges are those of the
    other tokens, and the second table has ``piece_id``, ``part``, ``token``, ``reason`` and how many ``times`` it stands
    there. A part without any pitch has no range; an empty table gives two empty ones.
    """
    sounding = cells.filter(F.col("token").isNotNull() & (F.trim("token") != rest)).select(
        "piece_id", "part", "token",
        pitch.name_to_midi(F.col("token")).alias("midi"), pitch.pitch_fault(F.col("token")).alias("reason"),
    )
    bad = sounding.filter("reason is not null").groupBy("piece_id", "part", "token", "reason").agg(
        F.count(F.lit(1)).alias("times")
    )
    return _ranges(sounding.filter("reason is null")), bad


def voice_ranges(events: DataFrame) -> DataFrame:
    """Lowest and highest pitch of every part that sounds."""
    return _ranges(sounding_notes(events))


def _ranges(pitches: DataFrame) -> DataFrame:
    spans = pitches.groupBy("piece_id", "part").agg(
        F.min("midi").alias("lowest_midi"), F.max("midi").alias("highest_midi")
    )
    return spans.select(
        "*",
        pitch.midi_to_name(F.col("lowest_midi")).alias("lowest_note"),
        pitch.midi_to_name(F.col("highest_midi")).alias("highest_note"),
        (F.col("highest_midi") - F.col("lowest_midi")).alias("range_semitones"),
    )


def range_axis(ranges: DataFrame) -> DataFrame:
    """Ends and ticks of the pitch axis of a piece."""
    ends = ranges.groupBy("piece_id").agg(
        F.min("lowest_midi").alias("x_min_midi"),
        F.max("highest_midi").alias("x_max_midi"),
        F.count(F.lit(1)).alias("staves"),
    )
    ticks = F.sequence("x_min_midi", "x_max_midi")
    return ends.select("*", ticks.alias("tick_values"), F.transform(ticks, pitch.midi_to_name).alias("tick_labels"))
