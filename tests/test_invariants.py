"""Facts that hold for any corpus."""

import pytest
from pyspark.sql import functions as F

from noteloom.operators import distribution, heatmap, intervals, ngrams, sonority, spans
from noteloom.plans import projection


@pytest.mark.parametrize("options", [{}, {"by_staff": True}, {"order": "chromatic", "limit_to_active": False}])
def test_shares_sum_to_one(events, options):
    table = distribution.weighted_distribution(events, **options)
    keys = ["piece_id", "staff"] if options.get("by_staff") else ["piece_id"]
    for row in table.groupBy(*keys).agg(F.sum("share").alias("s"), F.count("*").alias("n")).collect():
        assert abs(row.s - 1) < 1e-9
        assert row.n <= 12


def test_counts_first_and_matches_agree(events):
    found = ngrams.melodic_ngrams(events, 3)
    counts = {(r.piece_id, r.pattern_string): r["count"] for r in ngrams.count_patterns(found).collect()}
    assert sum(counts.values()) == found.count()
    earliest = {
        (r.piece_id, r.pattern_string): r.q
        for r in found.groupBy("piece_id", "pattern_string").agg(F.min(F.col("onset_ppq") / 480).alias("q")).collect()
    }
    for row in ngrams.first_occurrences(found).collect():
        key = (row.piece_id, row.pattern_string)
        assert row["count"] == counts[key] and row.start_q == earliest[key]
        assert row.end_q == row.start_q + row.duration
    assert found.filter(F.size("note_ids") != 4).count() == 0
    assert found.filter(F.size("pattern") != 3).count() == 0


def test_counts_are_ranked(events):
    rows = ngrams.count_patterns(ngrams.melodic_ngrams(events, 2), ordered=True).collect()
    keys = [(r.piece_id, -r["count"], r.pattern_string) for r in rows]
    assert keys == sorted(keys)


def test_span_of_a_match_gives_its_notes(events):
    found = ngrams.melodic_ngrams(events, 3)
    rows = found.select(
        "piece_id", (F.col("seq") * 8 + F.col("part")).alias("index"), F.col("measure").alias("start_measure"),
        F.col("beat").alias("start_beat"), (F.col("onset_ppq") / F.col("ppq")).alias("start_offset"),
        F.lit(4).alias("note_count"), F.col("part").cast("string").alias("column"), F.col("note_ids").alias("expected"),
    )
    resolved = spans.resolve_spans(events, rows)
    assert resolved.count() == found.count()
    assert resolved.filter("note_ids != expected").count() == 0
    assert resolved.filter(F.array_join("matched_parts", ",") != F.col("column")).count() == 0


def test_each_pair_of_sounding_notes_once(events):
    pairs = intervals.sounding_pairs(events, ["seq"])
    keys = ["piece_id", "low_part", "high_part", "onset_ppq"]
    assert pairs.count() == pairs.select(*keys).distinct().count()


def test_heatmap_occurrences_add_up(events):
    found = ngrams.melodic_ngrams(events, 2)
    top = {r.pattern_string: r["count"] for r in heatmap.top_patterns(found, 2).collect()}
    shown = heatmap.occurrences(found, 2)
    assert {r.pattern_string: r["count"] for r in shown.groupBy("pattern_string").count().collect()} == top
    assert shown.filter("end_q <= start_q").count() == 0
    with pytest.raises(ValueError):
        heatmap.top_patterns(found, 0)


def test_progress_and_introductions(spark, sf_dir, events):
    grams = sonority.corpus_ngrams(events, 1)
    assert grams.filter("progress < 0 or progress > 1").count() == 0
    pieces = projection.metadata(spark, sf_dir).select("piece_id", "score_index")
    rows = sonority.introduced_patterns(grams, pieces)
    assert rows.count() == rows.select("pattern_string").distinct().count() == grams.select("pattern_string").distinct().count()
    shown = sonority.introduced_occurrences(grams, rows)
    assert shown.count() == rows.agg(F.sum("count")).first()[0]
    with pytest.raises(ValueError):
        sonority.corpus_ngrams(events, 0)
