"""Sonorities over the lowest voice, their n-grams, and where scores introduce them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import metre, patterns, pitch
from noteloom.operators.intervals import UNIT_QUARTERS, time_blocks
from noteloom.operators.notes import beat
from noteloom.operators.ordered import BLOCK_ROWS, halo, neighbours, running, settle
from noteloom.sources.tables import store

# Ticks per block of onsets. Onsets of a piece are distinct integers, so a block
# never holds more rows than this; in practice a hundredth of it.
BLOCK_TICKS = 1 << 22


def sonorities(events: DataFrame, compound: bool = True, sort: bool = False,
               quarters: int = UNIT_QUARTERS) -> DataFrame:
    """What sounds at every onset of a piece.

    ``sonority`` lists the intervals of the other sounding voices above the
    lowest one, top part first, or widest first with ``sort``; it is empty when
    fewer than two voices sound. An onset meets the notes that cover it in the blocks of time they are
    cut into; what each block adds is gathered there, on the join's partitioning, and
    an onset then has one row for each size of block in use.
    """
    rows = time_blocks(events, quarters)
    shared = ("measure", "measure_onset_ppq", "ppq", "meter_count", "meter_unit")
    onsets = rows.filter("begins").groupBy("piece_id", "block", "onset_ppq").agg(*[F.min(c).alias(c) for c in shared])
    voices = rows.filter("covers").select(
        "piece_id", "block", "part", "midi", "dpos", F.col("onset_ppq").alias("from_ppq"), F.col("end_ppq").alias("to_ppq")
    )
    covered = onsets.join(voices, ["piece_id", "block"]).filter("from_ppq <= onset_ppq and onset_ppq < to_ppq")
    # One entry per part that has a note or rest here: as many as the piece has parts.
    entries = F.collect_list(
        F.when(
            F.col("midi").isNotNull(),
            F.struct("midi", (-F.col("part")).alias("below"), "dpos", F.col("from_ppq").alias("since")),
        )
    )
    by_block = covered.groupBy("piece_id", "block", "onset_ppq").agg(
        *[F.min(c).alias(c) for c in shared], entries.alias("voices"), F.max("to_ppq").alias("to_ppq")
    )
    gathered = by_block.groupBy("piece_id", "onset_ppq").agg(
        *[F.min(c).alias(c) for c in shared],
        F.flatten(F.collect_list("voices")).alias("voices"),
        F.max("to_ppq").alias("to_ppq"),
    )
    low = gathered.withColumn("low", F.array_min("voices"))
    others = F.filter("voices", lambda v: v["below"] != F.col("low.below"))

    def entry(v: Column) -> Column:
        token = pitch.interval("q", F.col("low.midi"), F.col("low.dpos"), v["midi"], v["dpos"], compound)
        rank = F.col("low.midi") - v["midi"] if sort else -v["below"]
        return F.struct(rank.alias("rank"), (-v["below"]).alias("part"), token.alias("token"))

    ranked = F.array_sort(F.transform(others, entry))
    return low.select(
        "piece_id",
        "onset_ppq",
        "ppq",
        "measure",
        "measure_onset_ppq",
        "meter_count",
        "meter_unit",
        "to_ppq",
        F.col("low.midi").alias("low_midi"),
        F.col("low.dpos").alias("low_dpos"),
        F.coalesce(-F.col("low.below"), F.lit(0)).alias("low_part"),
        F.coalesce(F.col("low.since"), F.lit(-1)).alias("low_since"),
        F.array_join(F.transform(ranked, lambda v: v["token"]), "/").alias("sonority"),
    )


def _onset_block() -> Column:
    return F.expr(f"cast(onset_ppq div {BLOCK_TICKS} as bigint)")


def _kept(minimum: float, keep_unmetred: bool) -> Column:
    """Whether an item takes part in n-grams: two voices, on a strong enough beat.

    A piece without any beat strength keeps all its items; asking for a minimum
    above 0 there is an error, raised while the job runs.
    """
    refused = F.raise_error(
        F.concat(F.col("piece_id"), F.lit(" states no metre, which minimum_beat_strength asks for"))
    ).cast("boolean")
    strong = F.when(F.col("metrical") == 1, F.coalesce(F.col("strength") >= minimum, F.lit(False))).otherwise(
        F.lit(True) if minimum <= 0 or keep_unmetred else refused
    )
    return (F.col("sonority") != "") & strong


def low_line_items(
    table: DataFrame, minimum_beat_strength: float = 0.0, block: Column | None = None, keep_unmetred: bool = False
) -> DataFrame:
    """The lowest line's next step at every onset, joined to the sonority.

    The low line has an entry where the lowest note is another than at the onset
    before; elsewhere it is ``Held``. A step into silence reads ``Rest``. ``kept``
    items form n-grams and are numbered by ``place`` within their piece. With a minimum a piece without metre ends
    the job, or stays whole with ``keep_unmetred``; ``fallback_warnings`` names such pieces.
    """
    block = _onset_block() if block is None else block
    strength = metre.beat_strength(
        F.col("measure_onset_ppq"), F.col("ppq"), F.col("meter_count"), F.col("meter_unit")
    )
    # The lowest note is named by its onset and part.
    lowest = F.when(F.col("low_since").isNotNull(), F.struct("low_since", "low_part"))
    named = table.withColumns({"low_key": lowest, "strength": strength})
    seen = running(
        named, ["piece_id"], ["onset_ppq"], block,
        lasts={"low_before": F.col("low_key")},
        totals={
            "end_ppq": ("max", F.col("to_ppq")),
            "metrical": ("max", F.col("strength").isNotNull().cast("int")),
        },
        keep_block=True,
    )
    moves = F.col("low_before").isNull() | (F.col("low_before") != F.col("low_key"))
    seen = seen.withColumns({"moves": moves, "kept": _kept(minimum_beat_strength, keep_unmetred)})
    # The next entry's pitch; both fields are null in silence.
    spelled = F.struct(F.col("low_midi").alias("midi"), F.col("low_dpos").alias("dpos"))
    ahead = running(
        seen, ["piece_id"], ["onset_ppq"], None,
        sums={"place": F.col("kept").cast("bigint")},
        nexts={"next_low": F.when(F.col("moves"), spelled)},
    )
    ahead = ahead.withColumns({
        "next_midi": F.col("next_low.midi"),
        "next_dpos": F.col("next_low.dpos"),
    })
    ahead = pitch.add_interval(ahead, "motion", "q", "low_", "next_")
    step = F.when(
        F.col("moves") & F.col("low_midi").isNotNull(),
        F.when(F.col("next_low").isNotNull() & F.col("next_midi").isNull(), F.lit("Rest")).otherwise(F.col("motion")),
    )
    low_line = F.coalesce(step, F.lit("Held"))
    return ahead.select(
        "piece_id",
        "onset_ppq",
        "ppq",
        "measure",
        "measure_onset_ppq",
        "end_ppq",
        "kept",
        "place",
        low_line.alias("low_line"),
        "sonority",
        F.concat_ws("_", low_line, "sonority").alias("item"),
    )


def fallback_warnings(table: DataFrame) -> DataFrame:
    """One line per piece whose beat-strength filter had to be skipped."""
    strength = metre.beat_strength(
        F.col("measure_onset_ppq"), F.col("ppq"), F.col("meter_count"), F.col("meter_unit")
    )
    seen = table.filter("sonority != ''").groupBy("piece_id").agg(F.max(strength.isNotNull()).alias("metrical"))
    text = F.concat(F.col("piece_id"), F.lit(" states no metre: all its onsets were kept"))
    return seen.filter(~F.col("metrical")).select("piece_id", text.alias("warning"))


def sonority_ngrams(items: DataFrame, n: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of ``n`` kept items of a piece, at the onset and progress of the first."""
    if n < 1:
        raise ValueError(f"an n-gram has one item or more, not {n}")
    window = neighbours(["piece_id"], "place")
    rows = halo(items.filter("kept"), "place", after=n - 1, size=block_rows)
    parts = [F.col("item"), *[F.lead("item", k).over(window) for k in range(1, n)]]
    pattern = F.concat(*[x for p in parts for x in (F.lit("_"), p)][1:])
    found = settle(rows.withColumn("pattern_string", pattern)).filter("pattern_string is not null")
    return found.select(
        "piece_id",
        "measure",
        beat().alias("beat"),
        "onset_ppq",
        (F.col("onset_ppq") / F.col("ppq")).alias("start_q"),
        patterns.clamp01(F.col("onset_ppq") / F.col("end_ppq")).alias("progress"),
        "pattern_string",
    )


def corpus_ngrams(events: DataFrame, n: int = 4, compound: bool = True, sort: bool = False,
                  minimum_beat_strength: float = 0.0) -> DataFrame:
    """From note events to sonority n-grams; the sonorities are stored on the way."""
    table = store(sonorities(events, compound, sort), "sonorities")
    return sonority_ngrams(low_line_items(table, minimum_beat_strength), n)


def introduced_patterns(ngrams: DataFrame, pieces: DataFrame) -> DataFrame:
    """Patterns of each score that no earlier score of the list has.

    ``pieces`` gives (piece_id, score_index). Occurrences are first reduced to
    one row per score and pattern, and only those rows meet again by pattern.
    """
    stats = ngrams.groupBy("piece_id", "pattern_string").agg(
        F.count(F.lit(1)).alias("count"), F.min("progress").alias("first_progress")
    )
    listed = stats.join(pieces, "piece_id")
    owner = listed.groupBy("pattern_string").agg(F.min("score_index").alias("score_index"))
    return listed.join(owner, ["pattern_string", "score_index"]).select(
        "score_index",
        "piece_id",
        patterns.row_id(F.col("piece_id"), F.col("pattern_string")).alias("row_id"),
        "pattern_string",
        "count",
        "first_progress",
    )


def introduced_occurrences(ngrams: DataFrame, introduced: DataFrame) -> DataFrame:
    """All occurrences of the introduced patterns in the score that introduces them."""
    return ngrams.join(
        introduced.select("piece_id", "pattern_string", "score_index", "row_id", F.col("count").alias("count_in_score")),
        ["piece_id", "pattern_string"],
    ).select(
        "score_index",
        "piece_id",
        "row_id",
        patterns.row_id(F.col("piece_id"), F.col("pattern_string"), F.col("start_q")).alias("id"),
        "pattern_string",
        "measure",
        "beat",
        "start_q",
        "progress",
        "count_in_score",
    )


def score_facts(ngrams: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per score: distinct patterns and the last start."""
    return (
        ngrams.groupBy("piece_id", "pattern_string")
        .agg(F.max("start_q").alias("last"))
        .groupBy("piece_id")
        .agg(F.count(F.lit(1)).alias("pattern_count"), F.max("last").alias("end_q"))
        .join(pieces, "piece_id")
    )


def summary(rows: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Totals of the shown patterns and the span of their occurrences."""
    shown = rows.agg(
        F.count(F.lit(1)).alias("pattern_count"), F.count_distinct("score_index").alias("score_count")
    )
    span = occurrences.agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("progress").alias("first_progress"),
        F.max("progress").alias("last_progress"),
    )
    # Two one-row tables side by side, without a join.
    both = shown.unionByName(span, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def most_recurring(rows: DataFrame, top: int = 5) -> DataFrame:
    return (
        rows.orderBy(F.desc("count"), "first_progress", "pattern_string")
        .limit(top)
        .select("pattern_string", "count", "first_progress")
    )
