"""Registered queries: one per operator, each with its SQL twin when it has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import patterns, pitch
from noteloom.operators import (
    cadence,
    distribution,
    excerpt,
    heatmap,
    intervals,
    ngrams,
    notes,
    profile,
    repeats,
    sonority,
    spans,
)
from noteloom.plans import oracle, projection
from noteloom.session import shared_folder
from noteloom.sources import catalogue, mei, sinks
from noteloom.sources.tables import stored_once

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _joined(df: DataFrame, *names: str) -> DataFrame:
    """Array columns as comma-joined text, so that results compare by value."""
    return df.withColumns({name: F.array_join(name, ",") for name in names})


EVENTS = oracle.EVENTS + oracle.NOTES
LINEITEM = oracle.LINEITEM + oracle.NOTES

_events = projection.note_events
_lines = projection.note_events_lineitem

_register("notes_table", lambda s, d: notes.note_table(_events(s, d)), EVENTS + oracle.NOTE_TABLE)


def _notes_wide(s: SparkSession, d: str) -> DataFrame:
    index = ["piece_id", "measure", "beat", "onset_ppq"]
    table = sinks.wide(notes.note_table(_events(s, d)), index, "part", "token", [1, 2, 3, 4, 5])
    return table.withColumnsRenamed({str(p): f"p{p}" for p in range(1, 6)})


_register("notes_wide", _notes_wide, EVENTS + oracle.NOTES_WIDE)
_register(
    "notes_long",
    lambda s, d: sinks.long(
        _notes_wide(s, d), ["piece_id", "measure", "beat", "onset_ppq"], [f"p{p}" for p in range(1, 6)], "part", "token"
    ),
    EVENTS + oracle.NOTES_LONG,
)

for _kind in ("c", "z", "d", "q"):
    _register(
        f"melodic_{_kind}",
        lambda s, d, k=_kind: intervals.melodic_intervals(_events(s, d), k),
        EVENTS + oracle.melodic(_kind),
    )

_register("harmonic_intervals", lambda s, d: intervals.harmonic_intervals(_events(s, d)), EVENTS + oracle.HARMONIC)
_register(
    "harmonic_intervals_lineitem",
    lambda s, d: intervals.harmonic_intervals(_lines(s, d)),
    LINEITEM + oracle.HARMONIC,
)


def _ngram_rows(df: DataFrame) -> DataFrame:
    return df.select("piece_id", "part", "seq", "measure", "beat", "onset_ppq", "pattern_string")


_register(
    "melodic_ngrams",
    lambda s, d: _ngram_rows(ngrams.melodic_ngrams(_events(s, d), 4)),
    EVENTS + oracle.ngrams(4) + oracle.NGRAM_ROWS,
)
_register(
    "melodic_ngrams_quality",
    lambda s, d: _ngram_rows(ngrams.melodic_ngrams(_events(s, d), 3, "q")),
    EVENTS + oracle.ngrams(3, "q") + oracle.NGRAM_ROWS,
)
_register(
    "ngrams_combined_unisons",
    lambda s, d: _joined(
        ngrams.matches(ngrams.melodic_ngrams(_events(s, d), 3, combine_unisons=True)), "note_ids"
    ),
    EVENTS + oracle.MERGED + oracle.ngrams(3, "d", "merged") + oracle.NGRAM_MATCHES,
)
_register(
    "ngram_entries",
    lambda s, d: _ngram_rows(ngrams.melodic_ngrams(_events(s, d), 4, entries=True)),
    EVENTS + oracle.ngrams(4) + oracle.NGRAM_ROWS + " WHERE opens",
)
_register(
    "ngram_counts",
    lambda s, d: ngrams.count_patterns(ngrams.melodic_ngrams(_events(s, d), 2, "c")),
    EVENTS + oracle.ngrams(2, "c") + oracle.NGRAM_COUNTS,
)
_register(
    "ngram_counts_lineitem",
    lambda s, d: ngrams.count_patterns(ngrams.melodic_ngrams(_lines(s, d), 4)),
    LINEITEM + oracle.ngrams(4) + oracle.NGRAM_COUNTS,
)
_register(
    "ngram_matches",
    lambda s, d: _joined(ngrams.matches(ngrams.melodic_ngrams(_events(s, d), 3)), "note_ids"),
    EVENTS + oracle.ngrams(3) + oracle.NGRAM_MATCHES,
)
_register(
    "ngram_matches_filtered",
    lambda s, d: _joined(
        ngrams.matches(ngrams.melodic_ngrams(_events(s, d), 2), ["2_2", " -2_-2 ", "1_1", ""]), "note_ids"
    ),
    EVENTS + oracle.ngrams(2) + oracle.NGRAM_MATCHES + " WHERE pattern_string IN ('2_2', '-2_-2', '1_1')",
)
_register(
    "first_occurrences",
    lambda s, d: _joined(ngrams.first_occurrences(ngrams.melodic_ngrams(_events(s, d), 3)), "note_ids"),
    EVENTS + oracle.ngrams(3) + oracle.FIRST_OCCURRENCES,
)

# Pitch classes, keys and ranges ---------------------------------------------


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


_register(
    "pitch_class_weights",
    lambda s, d: _rounded(distribution.weighted_distribution(_events(s, d)), 9, "share"),
    EVENTS + oracle.weights(),
)
_register(
    "pitch_class_weights_by_staff",
    lambda s, d: _rounded(
        distribution.weighted_distribution(_events(s, d), by_staff=True, order="chromatic", limit_to_active=False),
        9, "share",
    ),
    EVENTS + oracle.weights(by_staff=True, active_only=False, order=oracle.CHROMATIC),
)
_register(
    "pitch_class_weights_lineitem",
    lambda s, d: _rounded(distribution.weighted_distribution(_lines(s, d)), 9, "share"),
    LINEITEM + oracle.weights(),
)
_register(
    "weights_summary",
    lambda s, d: _rounded(
        distribution.distribution_summary(
            distribution.weighted_distribution(_events(s, d)), projection.metadata(s, d)
        ),
        9, "radial_max",
    ),
    EVENTS + oracle.META + oracle.KEYS + oracle.SUMMARY,
)
_register(
    "weights_traces",
    lambda s, d: distribution.traces(
        distribution.weighted_distribution(_events(s, d), by_staff=True), projection.metadata(s, d)
    ),
    EVENTS + oracle.META + oracle.TRACES,
)
_register(
    "key_finding",
    lambda s, d: _rounded(distribution.keys_of(_events(s, d)), 6, "confidence"),
    EVENTS + oracle.KEYS + "SELECT * FROM keys",
)
_register(
    "key_finding_lineitem",
    lambda s, d: _rounded(distribution.keys_of(_lines(s, d)), 6, "confidence"),
    LINEITEM + oracle.KEYS + "SELECT * FROM keys",
)
_register(
    "corpus_key_distribution",
    lambda s, d: distribution.key_distribution(distribution.keys_of(_lines(s, d))),
    LINEITEM + oracle.KEYS + "SELECT key_name, count(*) AS pieces FROM keys GROUP BY key_name",
)
_register(
    "voice_ranges",
    lambda s, d: distribution.voice_ranges(_events(s, d)),
    EVENTS + oracle.RANGES + "SELECT * FROM ranges",
)
_register(
    "voice_range_axis",
    lambda s, d: _joined(
        distribution.range_axis(distribution.voice_ranges(_events(s, d))), "tick_values", "tick_labels"
    ),
    EVENTS + oracle.RANGES + oracle.RANGE_AXIS,
)
_register(
    "token_ranges",
    lambda s, d: distribution.ranges_of_tokens(projection.tokens(s, d))[0],
    oracle.TOKENS + oracle.TOKEN_RANGES,
)
_register(
    "unreadable_tokens",
    lambda s, d: distribution.ranges_of_tokens(projection.tokens(s, d))[1],
    oracle.TOKENS + oracle.UNREADABLE_TOKENS,
)
_register(
    "pitch_names",
    lambda s, d: _events(s, d).filter("midi is not null").select(
        "midi",
        pitch.midi_to_name(F.col("midi")).alias("token"),
        pitch.name_to_midi(pitch.midi_to_name(F.col("midi"))).alias("midi_again"),
        pitch.pitch_class(F.col("midi")).alias("pc"),
    ).groupBy("midi", "token", "midi_again", "pc").agg(F.count(F.lit(1)).alias("notes")),
    EVENTS + oracle.PITCH_NAMES,
)


def _spelled(s: SparkSession, d: str) -> DataFrame:
    def pick(values: list[str], index: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({index} + 1 as int)"))

    named = projection.table(s, d, "part").select(
        "p_partkey",
        pick(list("cdefgab"), "p_partkey % 7").alias("pname"),
        pick(["n", "s", "ss", "x", "xs", "f", "ff", "tf", "sss", "ffff", "", "q"], "p_size % 12").alias("accid"),
    )
    return named.select(
        "*",
        pitch.accidental_semitones(F.col("accid")).alias("semitones"),
        pitch.spelled_pitch_class(F.col("pname"), F.lit(None).cast("string"), F.col("accid")).alias("pc"),
    )


_register("accidentals", _spelled, oracle.SPELLED)


def _pattern_keys(s: SparkSession, d: str) -> DataFrame:
    text = F.expr(
        "case p_partkey % 3 when 0 then replace(p_name, ' ', '__') when 1 then replace(p_name, ' ', ', ,')"
        " else concat(replace(p_name, ' ', '_'), ',', p_size) end"
    )
    labels = F.expr(
        "concat(p_size, element_at(array('::', '-', ' , ', '/', '_'), cast(p_partkey % 5 + 1 as int)), p_partkey % 9)"
    )
    return projection.table(s, d, "part").select(
        "p_partkey",
        patterns.pattern_key(text).alias("pattern_key"),
        patterns.pattern_key(text, comma_first=True).alias("module_key"),
        F.array_join(patterns.part_labels(labels), "|").alias("parts"),
    )


_register("pattern_keys", _pattern_keys, oracle.PATTERN_KEYS)

# Heatmap --------------------------------------------------------------------

_META = EVENTS + oracle.META


def _trigrams(s: SparkSession, d: str) -> DataFrame:
    return ngrams.melodic_ngrams(_events(s, d), 3)


_register(
    "ngram_heatmap_patterns",
    lambda s, d: heatmap.top_patterns(_trigrams(s, d), 3),
    EVENTS + oracle.ngrams(3) + oracle.TOP + "SELECT * FROM coloured",
)
_register(
    "ngram_heatmap_rows",
    lambda s, d: heatmap.timeline_rows(_events(s, d), projection.metadata(s, d)),
    _META + oracle.HEATMAP_ROWS,
)
_register(
    "ngram_heatmap_occurrences",
    lambda s, d: _joined(heatmap.occurrences(_trigrams(s, d), 3), "note_ids"),
    EVENTS + oracle.ngrams(3) + oracle.TOP + oracle.HEATMAP_OCCURRENCES,
)
_register(
    "ngram_heatmap_axis",
    lambda s, d: heatmap.time_axis(
        heatmap.timeline_rows(_events(s, d), projection.metadata(s, d)), heatmap.occurrences(_trigrams(s, d), 3)
    ),
    EVENTS + "SELECT max(end_ppq) / 480.0::DOUBLE AS x_max FROM note_events WHERE midi IS NOT NULL",
)

# Spans ----------------------------------------------------------------------

_register(
    "span_resolution",
    lambda s, d: _joined(
        spans.resolve_spans(_events(s, d), projection.spans(_events(s, d))), "matched_parts", "note_ids"
    ).select("piece_id", "index", "matched_parts", "note_ids"),
    EVENTS + oracle.SPANS + oracle.RESOLVED_SPANS,
)
_register(
    "span_notes",
    lambda s, d: _joined(spans.resolve(_events(s, d), projection.spans(_events(s, d))), "note_ids").drop("part_order"),
    EVENTS + oracle.SPANS + oracle.SPAN_NOTES,
)

# Sonorities -----------------------------------------------------------------


def _sonorities(s: SparkSession, d: str) -> DataFrame:
    return stored_once(s, f"sonorities:{d}", lambda: sonority.sonorities(_events(s, d)), f"{d}/events.parquet")


def _items(s: SparkSession, d: str) -> DataFrame:
    return sonority.low_line_items(_sonorities(s, d))


def _grams(s: SparkSession, d: str) -> DataFrame:
    return stored_once(s, f"sonority-bigrams:{d}", lambda: sonority.sonority_ngrams(_items(s, d), 2), f"{d}/events.parquet")


def _introduced(s: SparkSession, d: str) -> DataFrame:
    return sonority.introduced_patterns(_grams(s, d), projection.metadata(s, d).select("piece_id", "score_index"))


def _sonority_rows(df: DataFrame) -> DataFrame:
    return df.select("piece_id", "onset_ppq", "measure", notes.beat().alias("beat"), "low_midi", "low_part", "sonority")


_STACKS = EVENTS + oracle.META + oracle.sonorities()
_ITEMS = _STACKS + oracle.LOW_LINE
_GRAMS = _ITEMS + oracle.sonority_ngrams(2)

_register("sonorities", lambda s, d: _sonority_rows(_sonorities(s, d)), _STACKS + oracle.SONORITY_ROWS)
_register(
    "sonorities_simple_sorted",
    lambda s, d: _sonority_rows(sonority.sonorities(_events(s, d), compound=False, sort=True)),
    EVENTS + oracle.sonorities(compound=False, sort=True) + oracle.SONORITY_ROWS,
)
_register(
    "low_line_items",
    lambda s, d: _items(s, d).select("piece_id", "onset_ppq", "low_line", "sonority", "item"),
    _ITEMS + oracle.LOW_LINE_ROWS,
)
_register(
    "sonority_ngrams_on_beats",
    lambda s, d: sonority.sonority_ngrams(sonority.low_line_items(_sonorities(s, d), 0.25), 2),
    _ITEMS + oracle.sonority_ngrams(2, "strength >= 0.25") + oracle.GRAM_ROWS,
)


def _without_metre(s: SparkSession, d: str) -> DataFrame:
    return projection.meter_missing(_sonorities(s, d), ["u3", "u7"])


_register(
    "beat_strength_fallback",
    lambda s, d: sonority.sonority_ngrams(
        sonority.low_line_items(_without_metre(s, d), 0.25, keep_unmetred=True), 2
    ),
    _ITEMS + oracle.sonority_ngrams(2, "strength >= 0.25 OR piece_id IN ('u3', 'u7')") + oracle.GRAM_ROWS,
)
_register(
    "beat_strength_warnings",
    lambda s, d: sonority.fallback_warnings(_without_metre(s, d)),
    _STACKS
    + "SELECT DISTINCT piece_id, concat(piece_id, ' states no metre: all its onsets were kept') AS warning"
    " FROM sonorities WHERE sonority <> '' AND piece_id IN ('u3', 'u7')",
)
_register("sonority_rows", _introduced, _GRAMS + oracle.INTRODUCED + oracle.INTRODUCED_ROWS)
_register(
    "sonority_occurrences",
    lambda s, d: sonority.introduced_occurrences(_grams(s, d), _introduced(s, d)),
    _GRAMS + oracle.INTRODUCED + oracle.INTRODUCED_OCCURRENCES,
)
_register(
    "sonority_scores",
    lambda s, d: sonority.score_facts(_grams(s, d), projection.metadata(s, d).select("piece_id", "score_index")),
    _GRAMS + oracle.SCORE_FACTS,
)
_register(
    "sonority_summary",
    lambda s, d: sonority.summary(
        _introduced(s, d), sonority.introduced_occurrences(_grams(s, d), _introduced(s, d))
    ),
    _GRAMS + oracle.INTRODUCED + oracle.SONORITY_SUMMARY,
)
_register(
    "sonority_most_recurring",
    lambda s, d: sonority.most_recurring(_introduced(s, d)),
    _GRAMS + oracle.INTRODUCED + oracle.MOST_RECURRING,
)

# Cadences and profiles ------------------------------------------------------

_register(
    "cadences",
    lambda s, d: _joined(cadence.cadences(_events(s, d), projection.metadata(s, d)), "cvfs"),
    _META + oracle.CADENCES + oracle.CADENCE_ROWS,
)
_register(
    "piece_profile",
    lambda s, d: _rounded(profile.piece_profile(_events(s, d), projection.metadata(s, d)), 6, "confidence"),
    _META + oracle.CADENCES + oracle.KEYS + oracle.ngrams(4) + oracle.PROFILE,
)

# Excerpts and repeats -------------------------------------------------------

_register(
    "excerpt",
    lambda s, d: _rounded(excerpt.excerpt(_events(s, d), 8.5, 40.0, 96), 9, "at_sec", "for_sec"),
    EVENTS + oracle.EXCERPT,
)
_register(
    "excerpt_bounds",
    lambda s, d: excerpt.excerpt_bounds(_events(s, d), 8.5, 40.0, 96),
    EVENTS + oracle.EXCERPT_BOUNDS,
)
_register(
    "measure_range",
    lambda s, d: excerpt.measure_range(_events(s, d), 5, 12).select(
        "piece_id", "part", "seq", "measure", "onset_ppq", "midi"
    ),
    EVENTS + oracle.MEASURE_RANGE,
)
_register(
    "performed_order",
    lambda s, d: repeats.performed_order(projection.measures(s, d)),
    oracle.MEASURES + oracle.PERFORMED + "SELECT * FROM performed",
)


def _performed_events(s: SparkSession, d: str) -> DataFrame:
    events = _events(s, d)
    measures = projection.measures_of(events)
    played = repeats.performed_events(events, repeats.performed_order(measures), measures)
    return played.select("piece_id", "part", "seq", "performed_seq", "onset_ppq")


_register(
    "performed_events",
    _performed_events,
    EVENTS + oracle.EVENT_MEASURES + oracle.PERFORMED + oracle.PERFORMED_EVENTS,
)



def _json_payload(s: SparkSession, d: str) -> DataFrame:
    """Ranked counts written as JSON lines and read again."""
    path = f"{shared_folder(s)}/noteloom/{s.sparkContext.applicationId}/payload-{uuid.uuid4().hex}"
    sinks.write_json({"counts": ngrams.count_patterns(ngrams.melodic_ngrams(_events(s, d), 2, "c"))}, path)
    return s.read.schema("piece_id string, pattern_string string, count bigint").json(f"{path}/counts")


_register("json_payload", _json_payload, EVENTS + oracle.ngrams(2, "c") + oracle.NGRAM_COUNTS)

# Catalogue ------------------------------------------------------------------

_register(
    "collections",
    lambda s, d: catalogue.collections(projection.catalogue(s, d)),
    oracle.SCORES + oracle.COLLECTIONS + "SELECT * FROM listed WHERE collection IS NOT NULL",
)
_register(
    "collection_counts",
    lambda s, d: catalogue.collection_counts(projection.catalogue(s, d)),
    oracle.SCORES + oracle.COLLECTIONS
    + "SELECT collection, count(*) AS files FROM listed WHERE collection IS NOT NULL GROUP BY collection",
)
_register(
    "catalogue_resolution",
    lambda s, d: catalogue.resolve(projection.catalogue(s, d)),
    oracle.SCORES + oracle.RESOLVED,
)
_register(
    "registered_scores",
    lambda s, d: catalogue.registered(projection.catalogue(s, d)),
    oracle.SCORES + "SELECT DISTINCT filename FROM scores WHERE source = 'registered'",
)
_register(
    "registry_after_changes",
    lambda s, d: catalogue.latest_changes(projection.registry_changes(s, d)).select("filename", "number", "path"),
    """
WITH changes AS (
  SELECT concat('Score_', doc_id // 3, '.mei') AS filename, doc_id * 2 AS number, 1 AS added, concat('/inbox/', doc_id) AS path
  FROM documents
  UNION ALL
  SELECT concat('Score_', item_id, '.mei'), item_id * 6 + 2, 0, NULL FROM benchmark)
SELECT filename, number, path FROM (
  SELECT *, row_number() OVER (PARTITION BY filename ORDER BY number DESC, added) AS back FROM changes)
WHERE back = 1 AND added = 1
""",
)
_register(
    "unregister",
    lambda s, d: catalogue.unregister(projection.catalogue(s, d), projection.removals(s, d)).select(
        "filename", "path", "source"
    ),
    oracle.SCORES + oracle.UNREGISTERED,
)


def _name_errors(s: SparkSession, d: str) -> DataFrame:
    last = F.element_at(F.split("url", "/"), -1)
    kind = F.col("page_id") % 4
    name = (
        F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(last, F.lit(".MEI"))).when(kind == 2, last).otherwise("  ")
    )
    return projection.table(s, d, "pages").select("page_id", catalogue.name_error(name).alias("error"))


_register("name_errors", _name_errors, oracle.NAME_ERRORS)
_register(
    "piece_list",
    lambda s, d: catalogue.piece_list(
        projection.table(s, d, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("name"))
    ),
    oracle.PIECE_LIST,
)

# Ties -----------------------------------------------------------------------


def _merged_ties(s: SparkSession, d: str) -> DataFrame:
    merged = notes.merge_ties(projection.tie_flags(_events(s, d)))
    return merged.select(
        "piece_id", "part", "seq", "note_place", "onset_ppq", "dur_ppq", "midi",
        F.coalesce(F.array_join("note_ids", ","), F.lit("")).alias("note_ids"),
    )


_register("merged_ties", _merged_ties, EVENTS + oracle.TIES)

# Documents ------------------------------------------------------------------


def _document_states(s: SparkSession, d: str) -> DataFrame:
    states = mei.scores(projection.document_rows(s, d))
    # The parser's own words about the place of a fault are left out.
    return states.drop("sha256").withColumn("error", F.substring_index("error", ":", 1))


def _document_events(s: SparkSession, d: str) -> DataFrame:
    events = mei.note_events(projection.document_rows(s, d))
    return _joined(events, "note_ids").select(
        "piece_id", "part", "staff", "seq", "onset_ppq", "dur_ppq", "measure", "midi", "dpos", "note_ids"
    )


_register("document_states", _document_states, oracle.DOCUMENTS + oracle.DOCUMENT_STATES)
_register(
    "document_hashes",
    lambda s, d: mei.scores(mei.elements(projection.texts_as_scores(s, d))).select("piece_id", "is_valid", "sha256"),
    "SELECT concat('text_', doc_id, '.mei') AS piece_id, false AS is_valid, sha256(text) AS sha256 FROM documents",
)
_register(
    "raw_documents",
    lambda s, d: catalogue.raw_documents(
        projection.texts_as_scores(s, d),
        projection.table(s, d, "benchmark").select(F.concat(F.lit("text_"), "item_id", F.lit(".mei")).alias("piece_id")),
    ),
    """
SELECT concat('text_', doc_id, '.mei') AS piece_id, text AS document FROM documents
WHERE doc_id IN (SELECT item_id FROM benchmark)
""",
)
_register(
    "document_metadata",
    lambda s, d: _joined(mei.metadata(projection.document_rows(s, d)), "analysts").select(
        "piece_id", "title", "composer", "analysts", "publication_date", "published"
    ),
    oracle.DOCUMENTS + oracle.DOCUMENT_METADATA,
)
_register("document_events", _document_events, oracle.DOCUMENTS + oracle.DOCUMENT_NOTES + oracle.DOCUMENT_EVENTS)
_register(
    "measure_timeline",
    lambda s, d: mei.timeline(projection.document_rows(s, d)),
    oracle.DOCUMENTS + oracle.DOCUMENT_NOTES + oracle.MEASURE_TIMELINE,
)
_register(
    "document_harmonic",
    lambda s, d: intervals.harmonic_intervals(mei.note_events(projection.document_rows(s, d))),
    oracle.DOCUMENTS + oracle.DOCUMENT_NOTES + oracle.HARMONIC,
)


def _document_performed(s: SparkSession, d: str) -> DataFrame:
    rows = projection.document_rows(s, d)
    order = repeats.performed_order(mei.measures(rows))
    played = repeats.performed_events(mei.note_events(rows), order, mei.timeline(rows))
    return played.select("piece_id", "part", "seq", "performed_seq", "onset_ppq")


_register(
    "document_performed",
    _document_performed,
    oracle.DOCUMENTS + oracle.DOCUMENT_NOTES + oracle.DOCUMENT_PERFORMED,
)
_register(
    "catalogue_json",
    lambda s, d: catalogue.as_json(projection.catalogue(s, d)),
    oracle.SCORES + oracle.COLLECTIONS
    + "SELECT CAST(json_object('collection', collection, 'filename', filename) AS VARCHAR) AS record FROM listed"
    " WHERE collection IS NOT NULL",
)
