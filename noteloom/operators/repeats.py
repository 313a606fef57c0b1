"""Performed order of measures: repeats and numbered endings written out.

The walk through a section is a small state: where the region in force began, which
region still takes endings after its ``rptend``, and the ending in force. What a
block of measures does to that state fits in one row, whatever its length, and two such
rows make one again. So every block is walked by itself from an unknown state, the
rows of the blocks are composed in order, and each block takes what it needs from the
state before it. Measures are shuffled once for the walk and once to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from noteloom.operators.ordered import BLOCK_ROWS, block_of, running
from noteloom.sources.tables import store

SECTION = ["piece_id", "section_seq"]
_BLOCK = [*SECTION, "block"]


def ending_numbers(n: Column, label: Column) -> Column:
    """The passes an ending is played in, from its number and label."""
    return F.transform(
        F.regexp_extract_all(F.concat_ws(" ", n, label), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")
    )


def _latest(value: str | Column, rows: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(rows)


def _before(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _through(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _after(place: str | Column, other: str | Column) -> Column:
    """Whether the first of two places exists and lies behind the second, or the second does not exist."""
    return F.coalesce(F.col(place) if isinstance(place, str) else place, F.lit(-1)) > F.coalesce(other, F.lit(-1))


def _signs(measures: DataFrame, block_rows: int) -> DataFrame:
    """What the walk needs of each measure: the places of its signs and the pass of its ending."""
    place, plain = F.col("measure_seq"), F.col("ending_seq").isNull()
    passes = F.coalesce("ending_passes", F.array().cast("array<int>"))
    first = F.when(F.array_contains(passes, 1), 1).when(F.array_contains(passes, 2), 2)
    return measures.select(
        *SECTION, "measure_seq", "n", block_of("measure_seq", block_rows).alias("block"),
        F.when(plain, place).alias("plain"),
        F.when(plain & F.col("left").contains("rptstart"), place).alias("open"),
        F.when(plain & F.col("right").contains("rptend"), place).alias("close"),
        F.when(~plain & F.col("after_other"), place).alias("break"),
        F.when(~plain, first).alias("ending_pass"),
        (~plain & (F.size(passes) > 0)).alias("has_number"),
    )


def _walked(signs: DataFrame) -> DataFrame:
    """Every block walked by itself, as if nothing came before it: all windows share one shuffle and one sort."""
    before, through = _before(_BLOCK, "measure_seq"), _through(_BLOCK, "measure_seq")
    ending = F.when(F.col("ending_pass").isNotNull(), F.struct(F.col("measure_seq").alias("at"), "ending_pass"))
    seen = signs.withColumns(
        {
            "close_before": _latest("close", before),
            "closes_before": F.count("close").over(before),
            "open_before": _latest("open", before),
            "plain_before": _latest("plain", before),
            "broken": _latest("break", through),
            "ending": ending,
        }
    ).withColumn("ending_before", _latest("ending", before))
    # Of the rptstarts between two rptends the first one counts.
    opening = F.when(~_after("open_before", "close_before"), F.col("open"))
    seen = seen.withColumn("opened", _latest(opening, through))
    seen = seen.withColumn("start", F.when(_after("opened", "close_before"), F.col("opened")))
    return seen.withColumn("closed", _latest(F.when(F.col("close").isNotNull(), F.struct("start")), before)["start"])


def _states(walked: DataFrame) -> DataFrame:
    """The state before each block: one row a block, composed over the blocks of a section in order."""
    effect = walked.groupBy(*_BLOCK).agg(
        F.max_by(F.when(F.col("close").isNull(), F.col("start")), "measure_seq").alias("start"),
        F.max_by("start", "close").alias("closed"),
        F.min("close").alias("first_close"),
        F.max("close").alias("last_close"),
        F.max("plain").alias("last_plain"),
        F.max("break").alias("last_break"),
        F.max_by("ending", F.when(F.col("ending").isNotNull(), F.col("measure_seq"))).alias("ending"),
    )
    before = _before(SECTION, "block")
    # An rptend forgets what was open; from there on the first block that leaves a region open counts.
    composed = effect.withColumn("resets", F.count("last_close").over(_through(SECTION, "block")))
    composed = composed.withColumn(
        "open_after", F.first("start", ignorenulls=True).over(_through([*SECTION, "resets"], "block"))
    ).withColumn("state_start", F.lag("open_after").over(Window.partitionBy(*SECTION).orderBy("block")))
    only = F.col("first_close") == F.col("last_close")
    closed = F.when(only, F.coalesce("state_start", "closed")).otherwise(F.col("closed"))
    takes_endings = (F.col("last_plain") == F.col("last_close")) & ~_after("last_break", "last_close")
    # A block of endings alone leaves the region that takes them as it is.
    decided = F.when(
        F.coalesce("last_plain", "last_break").isNotNull(), F.struct(F.when(takes_endings, closed).alias("region"))
    )
    return composed.withColumn("decided", decided).select(
        *_BLOCK, "state_start",
        _latest("decided", before)["region"].alias("state_tail"),
        _latest("ending", before).alias("state_ending"),
        F.max("last_close").over(Window.partitionBy(*SECTION)).alias("section_close"),
    )


def _regions(signs: DataFrame) -> DataFrame:
    """Each measure with its region, the ending in force there, and the rows of the region in its block."""
    walked = _walked(signs)
    row = walked.join(_states(walked), _BLOCK)
    nothing_closed = F.col("close_before").isNull()
    start = F.when(nothing_closed, F.coalesce("state_start", "start")).otherwise(F.col("start"))
    closed = F.when(F.col("closes_before") == 1, F.coalesce("state_start", "closed")).otherwise(F.col("closed"))
    # Endings right after an rptend still belong to the region it closes.
    tail = F.when(F.col("plain_before").isNull() & F.col("broken").isNull(), F.col("state_tail")).when(
        (F.col("plain_before") == F.col("close_before")) & ~_after("broken", "close_before"), closed
    )
    placed = row.withColumn(
        "region",
        F.coalesce(
            # What no rptend follows is no region.
            F.when(F.col("measure_seq") <= F.col("section_close"), start),
            F.when(F.col("plain").isNull(), tail),
        ),
    )
    earlier = F.coalesce("ending_before", "state_ending")
    in_force = F.when(F.col("plain").isNull(), F.col("ending_pass")).when(
        earlier["at"] > F.col("region"), earlier["ending_pass"]
    )
    here = Window.partitionBy(*_BLOCK, "region")
    return placed.select(
        *_BLOCK, "measure_seq", "n", "region", in_force.alias("in_force"),
        F.col("plain").isNotNull().alias("plain"),
        F.max("has_number").over(here).alias("numbered"),
        F.count(F.lit(1)).over(here).alias("region_rows"),
    )


def _with_totals(regions: DataFrame, block_rows: int) -> DataFrame:
    """``numbered`` and ``region_rows`` of whole regions: only regions that pass a block's edge are added up.

    At most one region enters a block and one leaves it, so those meet the measures with at most two rows a block.
    """
    cut = [*_BLOCK, "region"]
    entering = regions.filter(block_of("region", block_rows) < F.col("block"))
    crossing = entering.select(*SECTION, "region").distinct()
    parts = (
        regions.join(crossing, [*SECTION, "region"], "left_semi")
        .groupBy(*cut).agg(F.max("numbered").alias("numbered"), F.max("region_rows").alias("region_rows"))
    )
    whole = Window.partitionBy(*SECTION, "region")
    totals = parts.select(
        *cut, F.max("numbered").over(whole).alias("any_numbered"), F.sum("region_rows").over(whole).alias("all_rows")
    )
    return regions.join(totals, cut, "left").withColumns(
        {
            "numbered": F.coalesce("any_numbered", "numbered"),
            "region_rows": F.coalesce("all_rows", "region_rows"),
        }
    )


def performed_measures(measures: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Place every measure in performed order.

    Input: one row per measure with ``piece_id``, ``section_seq``, ``measure_seq``
    (unique and increasing in the piece), ``n``, ``left``, ``right``, and for a
    measure inside an ending ``ending_seq`` and ``ending_passes``; ``after_other``
    marks an ending that follows something else than a measure or an ending (a page
    break, say), which ends the run of endings after an ``rptend``. A region runs
    from the first ``rptstart`` after the last ``rptend`` to the next ``rptend``,
    plus the endings that follow directly. It is played twice; with endings
    numbered 1 or 2 the part before them is played, then ending 1, then that part
    again, then ending 2. Endings outside a region are not played.

    Null signs are no signs, and a null ``after_other`` is false; a piece without signs is played as it stands,
    and an empty table gives no rows.
    """
    # Both passes that follow read the stored rows, so that blocks are walked once.
    regions = _with_totals(store(_regions(_signs(measures, block_rows)), "repeat-regions"), block_rows)
    both = F.array(F.lit(10), F.lit(20))
    inside = F.col("region").isNotNull()
    stages = (
        F.when(~inside, F.when(F.col("plain"), F.array(F.lit(10))))
        .when(~F.col("numbered"), both)
        .when(F.col("in_force") == 1, F.array(F.lit(11)))
        .when(F.col("in_force") == 2, F.array(F.lit(21)))
        .when(F.col("plain"), both)
    )
    return regions.select(
        *SECTION, "measure_seq", "n",
        F.coalesce("region", "measure_seq").alias("region"),
        F.when(inside, F.col("region_rows")).otherwise(F.lit(1)).alias("region_rows"),
        F.explode(stages).alias("stage"),
    ).withColumn("pass", F.expr("cast(stage div 10 as int)"))


def performed_order(measures: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Performed measures numbered from 1 through the piece."""
    played = performed_measures(measures, block_rows)
    # Short regions share a block with their neighbours. A region longer than a
    # block is the last one that starts in it, and is cut by pass and measure.
    long = F.col("region_rows") > block_rows
    block = F.struct(
        block_of("region", block_rows).alias("start"),
        F.when(long, F.col("stage")).otherwise(F.lit(0)).alias("stage"),
        F.when(long, block_of("measure_seq", block_rows) + 1).otherwise(F.lit(0)).alias("stretch"),
    )
    numbered = running(
        played, ["piece_id"], ["region", "stage", "measure_seq"], block,
        sums={"earlier": F.lit(1)},
    )
    return numbered.select(
        "piece_id", (F.col("earlier") + 1).cast("bigint").alias("performed_seq"), "measure_seq", "n", "pass"
    )


def performed_events(
    events: DataFrame, order: DataFrame, lengths: DataFrame, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Note events in performed order, with onsets counted anew.

    ``lengths`` (piece_id, measure_seq, length_ppq) are those of the measures themselves, as ``mei.timeline`` gives
    them: a note held over the barline does not lengthen its measure, and a measure without onsets keeps its time.
    """
    sized = order.select("piece_id", "measure_seq", "performed_seq").join(
        lengths.select("piece_id", "measure_seq", "length_ppq"), ["piece_id", "measure_seq"], "left"
    )
    # The pass that follows reads its rows twice, and the order itself is made by such passes.
    laid = running(
        store(sized, "performed-lengths"), ["piece_id"], ["performed_seq"], block_of("performed_seq", block_rows),
        sums={"measure_start_ppq": F.coalesce("length_ppq", F.lit(0))},
    )
    return (
        events.drop("onset_ppq")
        .join(laid.select("piece_id", "measure_seq", "performed_seq", "measure_start_ppq"), ["piece_id", "measure_seq"])
        .withColumn("onset_ppq", F.col("measure_start_ppq") + F.col("measure_onset_ppq"))
        .drop("measure_start_ppq")
    )
