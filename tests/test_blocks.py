"""Results do not depend on where sequences are cut into blocks."""

import pytest
from pyspark.sql import functions as F

from noteloom.operators import cadence, excerpt, intervals, ngrams, notes, sonority
from noteloom.operators.ordered import block_of, halo, neighbours, running, settle
from noteloom.plans import projection


def rows(df):
    return sorted(map(str, df.collect()))


def same(left, right):
    a, b = rows(left), rows(right)
    assert a and a == b


@pytest.mark.parametrize("size", [3, 7])
def test_notes_and_intervals(events, size):
    same(notes.note_table(events, size), notes.note_table(events))
    same(intervals.melodic_intervals(events, "q", block_rows=size), intervals.melodic_intervals(events, "q"))
    same(notes.combine(events, True, size), notes.combine(events, True))


@pytest.mark.parametrize("size", [4, 9])
@pytest.mark.parametrize("options", [{}, {"entries": True}, {"combine_unisons": True}, {"kind": "q", "compound": False}])
def test_ngrams(events, size, options):
    same(ngrams.melodic_ngrams(events, 3, block_rows=size, **options), ngrams.melodic_ngrams(events, 3, **options))


def test_block_shorter_than_the_window_is_refused(events):
    with pytest.raises(ValueError):
        ngrams.melodic_ngrams(events, 5, block_rows=5)


@pytest.mark.parametrize("size", [4, 9])
def test_ties_and_cadences(spark, sf_dir, events, size):
    tied = projection.tie_flags(events)
    same(notes.merge_ties(tied, size), notes.merge_ties(tied))
    meta = projection.metadata(spark, sf_dir)
    same(cadence.cadences(events, meta, size), cadence.cadences(events, meta))


def test_sonorities(events):
    table = sonority.sonorities(events)
    small = F.expr("cast(onset_ppq div 2000 as bigint)")
    same(sonority.low_line_items(table, block=small), sonority.low_line_items(table))
    items = sonority.low_line_items(table, 0.25)
    same(sonority.sonority_ngrams(items, 3, 5), sonority.sonority_ngrams(items, 3))


@pytest.mark.parametrize("quarters", [1, 5, 40])
def test_width_of_time_blocks(events, quarters):
    keep = ["low_part", "high_part", "onset_ppq", "low_midi", "high_midi"]
    same(
        intervals.sounding_pairs(events, ["midi"], quarters).select("piece_id", *keep),
        intervals.sounding_pairs(events, ["midi"]).select("piece_id", *keep),
    )
    same(sonority.sonorities(events, quarters=quarters), sonority.sonorities(events))


def test_number_of_partitions(spark, events):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    many = rows(ngrams.melodic_ngrams(events, 3))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(ngrams.melodic_ngrams(events, 3)) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_by_hand(spark):
    values = [(k, i, (i * 7 + len(k)) % 5 if i % 3 else None) for k in ("a", "bb") for i in range(20)]
    df = spark.createDataFrame(values, "k string, i bigint, v bigint")
    got = running(
        df, ["k"], ["i"], block_of("i", 4),
        sums={"s": F.coalesce("v", F.lit(0))}, lasts={"last": F.col("v")}, nexts={"next": F.col("v")},
        totals={"top": ("max", F.col("v")), "all": ("sum", F.col("v"))},
    )
    for k in ("a", "bb"):
        mine = [v for key, _, v in values if key == k]
        known = [v for v in mine if v is not None]
        for row in got.filter(F.col("k") == k).collect():
            earlier, later = mine[: row.i], mine[row.i + 1 :]
            assert row.s == sum(v or 0 for v in earlier)
            assert row["last"] == next((v for v in reversed(earlier) if v is not None), None)
            assert row["next"] == next((v for v in later if v is not None), None)
            assert (row.top, row["all"]) == (max(known), sum(known))


def test_halo_by_hand(spark):
    df = spark.range(25).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    window = neighbours(["k"], "i")
    got = settle(
        halo(df, "i", before=2, after=3, size=6).withColumns(
            {"back": F.lag("i", 2).over(window), "ahead": F.lead("i", 3).over(window)}
        )
    ).collect()
    assert sorted(r.i for r in got) == list(range(25))
    for r in got:
        assert r.back == (r.i - 2 if r.i >= 2 else None)
        assert r.ahead == (r.i + 3 if r.i + 3 < 25 else None)


def test_one_piece_with_most_rows(spark, events):
    """A piece with more notes than all others together gives the same rows as alone."""
    giant = events.filter("piece_id = 'u1'")
    pile = events.unionByName(giant.withColumn("piece_id", F.lit("giant")))
    for build in (lambda e: ngrams.melodic_ngrams(e, 3, block_rows=8), intervals.harmonic_intervals):
        alone = rows(build(giant).drop("piece_id"))
        assert rows(build(pile).filter("piece_id = 'giant'").drop("piece_id")) == alone


def test_excerpt_arguments(events):
    for bad in ({"start_q": -1}, {"start_q": 4, "end_q": 4}, {"bpm": 0}):
        with pytest.raises(ValueError):
            excerpt.excerpt_bounds(events, **bad)
