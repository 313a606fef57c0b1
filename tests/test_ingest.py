"""From score documents to tables."""

import datetime
import hashlib

import pytest
from documents import line, measure, note, rest, score
from pyspark.sql import functions as F

from noteloom.operators import cadence, distribution, intervals, ngrams, notes, repeats, sonority
from noteloom.sources import catalogue, mei
from noteloom.sources.tables import store


@pytest.fixture
def ingest(spark, tmp_path):
    def run(**documents):
        for name, text in documents.items():
            (tmp_path / f"{name}.mei").write_text(text, encoding="utf-8")
        (tmp_path / "notes.txt").write_text("not a score")
        rows = mei.elements(mei.read_documents(spark, str(tmp_path)))
        path = str(tmp_path / "stored")
        rows.write.parquet(path)
        return spark.read.schema(mei.ELEMENTS).parquet(path)

    return run


def part(events, number, *columns):
    found = events.filter(F.col("part") == number).orderBy("seq").select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in found]


def test_document_order_and_onsets(ingest):
    body = "<section>" + measure(
        1,
        rest(120) + "<beam>" + line("c4:120 d4:120 e4:120", "a") + "</beam>" + note("g4", 240, "a4"),
        line("c3:720", "b"),
    ) + "</section>"
    events = mei.note_events(ingest(one=score(body)))
    assert part(events, 1, "onset_ppq", "dur_ppq", "midi") == [
        (0, 120, None), (120, 120, 60), (240, 120, 62), (360, 120, 64), (480, 240, 67)
    ]
    assert part(events, 1, "note_ids") == [None, ["a1"], ["a2"], ["a3"], ["a4"]]
    assert part(events, 1, "note_place") == [None, 0, 1, 2, 3]
    assert part(events, 2, "onset_ppq", "midi", "staff") == [(0, 48, "2")]


def test_parts_are_numbered_by_first_appearance(ingest):
    body = (
        '<section><measure n="1"><staff n="2"><layer n="2">' + note("c4", 480) + '</layer></staff>'
        '<staff n="1"><layer n="1">' + note("c5", 480) + "</layer></staff></measure></section>"
    )
    events = mei.note_events(ingest(one=score(body)))
    assert part(events, 1, "midi") == [60] and part(events, 2, "midi") == [72]


def test_ticks_from_note_values_and_metre(ingest):
    body = "<section>" + measure(
        1,
        '<note pname="c" oct="4" dur="2" dots="1"/><tuplet num="3" numbase="2"><note pname="d" oct="4" dur="4"/>'
        '<note pname="e" oct="4" dur="4"/><note pname="f" oct="4" dur="4"/></tuplet><note pname="g" oct="4" dur="8" grace="acc"/>'
        '<note pname="a" oct="4" dur="breve"/>',
        "<mRest/>",
    ) + measure(2, note("c4", 256), "<mRest/>") + "</section>"
    definition = '<scoreDef ppq="256" meter.count="3" meter.unit="2"/>'
    rows = ingest(one=score(body, definition))
    events = mei.note_events(rows)
    third = round(256 * 2 / 3)
    assert part(events, 1, "dur_ppq") == [768, third, third, third, 0, 2048, 256]
    assert part(events, 2, "dur_ppq") == [256 * 6, 256 * 6]
    assert part(events, 1, "missing_dur") == [True] * 6 + [False]
    assert part(events, 1, "ppq") == [256] * 7
    encoded = mei.note_events(rows, timing="encoded")
    assert part(encoded, 1, "onset_ppq", "dur_ppq") == [(0, 0)] * 6 + [(1024, 256)]
    assert part(encoded, 2, "dur_ppq") == [1024, 1024]
    with pytest.raises(ValueError):
        mei.note_events(rows, timing="other")


def test_staff_ppq_is_brought_to_the_score(ingest):
    definition = (
        '<scoreDef ppq="240"><staffGrp><staffDef n="1" ppq="480"/><staffDef n="2"/></staffGrp></scoreDef>'
    )
    body = "<section>" + measure(1, line("c4:480 d4:480", "a"), line("c3:240 d3:240", "b")) + "</section>"
    events = mei.note_events(ingest(one=score(body, definition)))
    assert part(events, 1, "onset_ppq") == [0, 480] == part(events, 2, "onset_ppq")


def test_ties_chords_and_velocities(ingest):
    body = "<section>" + measure(
        1,
        note("c4", 480, "a1") + note("c4", 480, "a2") + note("d4", 480, "a3", 'tie="i"') + note("d4", 480, "a4", 'tie="t"'),
        '<chord dur.ppq="960"><note xml:id="c1" pname="e" oct="3" vel="0"/><note xml:id="c2" pname="g" oct="3"/></chord>'
        '<chord dur="2"><note xml:id="c3" pname="c" oct="3"/></chord>',
        extra='<tie startid="#a1" endid="#a2"/>',
    ) + "</section>"
    events = mei.note_events(ingest(one=score(body)))
    assert part(events, 1, "seq", "midi", "dur_ppq") == [(1, 60, 960), (2, 62, 960)]
    assert part(events, 1, "note_ids") == [["a1", "a2"], ["a3", "a4"]]
    assert part(events, 2, "midi", "dur_ppq") == [(55, 960), (48, 960)]
    assert part(events, 2, "note_ids") == [["c1", "c2"], ["c3"]]
    pitches = events.filter("part = 2").select(F.explode("pitches").alias("p")).select("p.midi", "p.vel").collect()
    assert {(r.midi, r.vel) for r in pitches} == {(52, 0), (55, None), (48, None)}


def test_a_tie_to_another_pitch_is_not_merged(ingest):
    body = "<section>" + measure(1, note("c4", 480, "a1") + note("d4", 480, "a2", 'tie="t"')) + "</section>"
    assert part(mei.note_events(ingest(one=score(body))), 1, "midi") == [60, 62]


def test_accidentals_sounding_and_written(ingest):
    body = "<section>" + measure(
        1,
        note("f4", 480, attrs='accid.ges="s"')
        + note("f#4", 480)
        + note("b4", 480, child='<accid accid="f"/>')
        + note("b4", 480, child='<accid accid.ges="f"/>')
        + note("c4", 480, attrs='accid="x"'),
    ) + "</section>"
    events = mei.note_events(ingest(one=score(body)))
    assert part(events, 1, "midi") == [66, 66, 70, 70, 62]
    sounding = {r.pc_label: r.weight_ppq for r in distribution.weighted_distribution(events).collect()}
    written = {r.pc_label: r.weight_ppq for r in distribution.weighted_distribution(events, written=True).collect()}
    assert sounding == {"F#": 960, "B-": 960, "D": 480}
    assert written == {"F#": 960, "B-": 480, "B": 480, "D": 480}


def test_quarantine_and_header_only(ingest):
    rows = ingest(
        bad="<mei><unclosed>", other="<html/>", header=score(""),
        good=score("<section>" + measure(1, note("c4", 480)) + "</section>"),
    )
    states = {r.piece_id: (r.is_valid, r.error) for r in mei.scores(rows).collect()}
    assert states["good.mei"] == states["header.mei"] == (True, None)
    assert states["other.mei"] == (False, "not a score: its root element is <html>, not <mei>")
    assert states["bad.mei"][1].startswith("not well-formed XML")
    events = mei.note_events(rows)
    assert {r.piece_id for r in events.select("piece_id").collect()} == {"good.mei"}
    assert mei.metadata(rows).count() == 2
    candidates = mei.scores(rows).select(F.col("piece_id").alias("filename"), "is_valid", "error")
    accepted, rejected = catalogue.registrations(candidates)
    assert accepted.count() == 2 and rejected.count() == 2


def test_metadata(ingest):
    found = mei.metadata(ingest(one=score("", title="T"))).first().asDict()
    assert found == {
        "piece_id": "one.mei", "title": "T", "composer": "Doe, Ann", "mei_editors": ["E. One", "E. Two"],
        "xml_editors": [], "analysts": ["A. Nalyst"], "publication_date": "2024-02-29", "availability": "free",
        "application": "Pen", "work_title": "The Work", "published": datetime.date(2024, 2, 29),
    }


def test_late_and_pausing_voices_meet_the_others(ingest):
    body = "<section>" + "".join([
        measure(1, line("c4:480", "p")),  # a pickup is as long as its notes
        measure(2, line("c4:960 d4:960", "a"), line("c3:480", "x")),
        measure(3, line("e4:1920", "b")),
        measure(4, line("f4:1920", "c"), line("d3:960 e3:960", "y")),
        measure(5), measure(6, line("g4:480", "d")),
    ]) + "</section>"
    rows = ingest(one=score(body, '<scoreDef ppq="480" meter.count="3" meter.unit="4"/>'))
    found = mei.timeline(rows).orderBy("measure_seq").collect()
    assert [(r.start_ppq, r.length_ppq) for r in found] == [
        (0, 480), (480, 1920), (2400, 1920), (4320, 1920), (6240, 1440), (7680, 480)
    ]
    events = mei.note_events(rows)
    assert part(events, 2, "onset_ppq") == [480, 4320, 5280]
    harmonic = intervals.harmonic_intervals(events).orderBy("onset_ppq").collect()
    assert {(r.onset_ppq, r.measure) for r in harmonic} == {(480, 2.0), (4320, 4.0), (5280, 4.0)}


def test_ties_over_barlines_do_not_stretch_measures(ingest):
    tied = 'tie="t"'
    body = "<section>" + "".join([
        measure(1, note("c4", 1920, "a", 'tie="i"'), attrs='left="rptstart"'),
        measure(2, note("c4", 1920, "b", tied)),
        measure(3, note("d4", 1920, "c"), attrs='right="rptend"'),
    ]) + "</section>"
    rows = ingest(one=score(body))
    events = mei.note_events(rows)
    assert part(events, 1, "onset_ppq", "dur_ppq") == [(0, 3840), (3840, 1920)]
    order = repeats.performed_order(mei.measures(rows))
    played = repeats.performed_events(events, order, mei.timeline(rows)).orderBy("onset_ppq").collect()
    assert [r.onset_ppq for r in played] == [0, 3840, 5760, 9600]


def test_events_of_unknown_length_are_kept(ingest):
    body = "<section>" + measure(1, note("c4", 480, "a") + note("d4", None, "g", 'grace="acc"') + note("e4", 480, "b")) + "</section>"
    events = mei.note_events(ingest(one=score(body)))
    assert part(events, 1, "onset_ppq", "dur_ppq", "missing_dur") == [(0, 480, False), (480, 0, True), (480, 480, False)]


def test_documents_that_used_to_end_the_job(spark):
    deep = "<section>" * 3000 + measure(1, note("c4", 480)) + "</section>" * 3000
    texts = {
        "code.mei": '<?xml version="1.0" encoding="gb2312"?><mei/>', "none.mei": None,
        "ppq.mei": score("<section>" + measure(1, note("c4")) + "</section>", '<scoreDef ppq="\u00b2"/>'),
        "large.mei": score("<section>" + measure(1, note("c4", 480)) + "</section>", '<scoreDef ppq="99999999999"/>'),
        "deep.mei": score(deep),
    }
    rows = [(name, None if text is None else bytearray(text.encode())) for name, text in texts.items()]
    flat = store(mei.elements(spark.createDataFrame(rows, "piece_id string, content binary")), "odd")
    states = {r.piece_id: r for r in mei.scores(flat).collect()}
    assert {name for name, r in states.items() if r.is_valid} == {"ppq.mei", "large.mei", "deep.mei"}
    assert states["code.mei"].error.startswith("unreadable: ") and states["none.mei"].error.startswith("unreadable: ")
    assert states["deep.mei"].sha256 == hashlib.sha256(texts["deep.mei"].encode()).hexdigest()
    assert {r.piece_id for r in mei.note_events(flat).collect()} == {"large.mei", "deep.mei", "ppq.mei"}


def test_missing_header_fields_are_null(ingest):
    text = '<mei xmlns="http://www.music-encoding.org/ns/mei"><music/></mei>'
    found = mei.metadata(ingest(bare=text)).first().asDict()
    assert found.pop("piece_id") == "bare.mei"
    assert all(value in (None, []) for value in found.values())


def test_entries_after_rest_section_and_fermata(ingest):
    first = measure(
        1, line("c4:480 d4:480 e4:480 -:480", "a"),
    ) + measure(2, line("f4:480 g4:480", "b") + note("a4", 480, "b3", 'fermata="above"') + line("g4:480 f4:480 e4:480", "c"))
    second = measure(3, line("c4:480 e4:480 g4:480", "d"))
    rows = ingest(one=score(f"<section>{first}</section><section>{second}</section>"))
    events = mei.note_events(rows)
    found = ngrams.melodic_ngrams(events, 2, entries=True).orderBy("seq").select("pattern_string").collect()
    assert [r[0] for r in found] == ["2_2", "2_2", "-2_-2", "3_3"]


def test_fermata_element(ingest):
    body = "<section>" + measure(
        1, line("c4:480 d4:480 e4:480 f4:480", "a"), extra='<fermata startid="#a2"/>'
    ) + "</section>"
    assert part(mei.note_events(ingest(one=score(body))), 1, "fermata") == [False, True, False, False]


def test_repeats_from_documents(ingest):
    def empty(n, attrs=""):
        return measure(n, note("c4", 1920), attrs=attrs)

    section = (
        empty(1) + empty(2, 'left="rptstart"') + empty(3)
        + '<ending n="1">' + empty(4) + "</ending>" + empty(5, 'right="rptend"')
        + '<ending n="2" label="2.">' + empty(6) + "</ending>"
        + empty(7, 'right="rptend"') + '<ending n="1">' + empty(8) + "</ending>"
        + empty(9, 'left="rptboth"') + empty(10, 'left="rptstart" right="rptend"')
        + "<pb/><ending n='2'>" + empty(11) + "</ending>" + empty(12, 'left="rptstart"')
    )
    rows = ingest(one=score(f"<section>{section}</section>"))
    order = repeats.performed_order(mei.measures(rows))
    numbers = [int(r.n) for r in order.orderBy("performed_seq").collect()]
    assert numbers == [1, 2, 3, 4, 5, 2, 3, 6, 7, 9, 10, 10, 12]
    played = repeats.performed_events(mei.note_events(rows), order, mei.timeline(rows)).orderBy("onset_ppq").collect()
    assert [r.onset_ppq for r in played] == [1920 * k for k in range(len(numbers))]
    assert [int(r.measure) for r in played] == numbers


CLOSE = {
    # bass, tenor, alto, cantus close on C: 4-3-8 over the bass, 7-6-8 over the tenor
    "cantus": "c5:480 c5:480 b4:480 c5:480",
    "alto": "-:480 g4:1440",
    "tenor": "d4:1440 c4:480",
    "bass": "g3:1440 c3:480",
}


def test_cadence_of_four_voices(ingest):
    voices = [CLOSE[v] for v in ("cantus", "alto", "tenor", "bass")]
    voices[0] = "c5:960 b4:480 c5:480"
    body = "<section>" + measure(1, *[line(v, f"v{i}") for i, v in enumerate(voices)]) + "</section>"
    rows = ingest(one=score(body))
    found = cadence.cadences(mei.note_events(rows), mei.metadata(rows)).collect()
    assert len(found) == 1
    (close,) = found
    assert (close.cad_type, close.tone, close.cvfs) == ("Authentic", "C", ["Ct", "T", "B"])
    assert (close.measure, close.beat, close.progress, close.composer) == (1.0, 4.0, 0.75, "Doe, Ann")


def test_evaded_cadence(ingest):
    voices = ["c5:960 b4:480 c5:480", "g3:1440 c3:480"]
    voices[0] = "c5:960 b4:480 e5:480"
    body = "<section>" + measure(1, *[line(v, f"v{i}") for i, v in enumerate(voices)]) + "</section>"
    rows = ingest(one=score(body))
    (close,) = cadence.cadences(mei.note_events(rows), mei.metadata(rows)).collect()
    assert (close.cad_type, close.tone) == ("Evaded", "C")


def test_phrygian_and_plagal(ingest):
    phrygian = "<section>" + measure(1, line("d5:480 e5:480", "a"), line("f4:480 e4:480", "b")) + "</section>"
    plagal = "<section>" + measure(1, line("c5:960", "a"), line("f4:480 c4:480", "b")) + "</section>"
    rows = ingest(phr=score(phrygian), pla=score(plagal))
    found = {r.piece_id: (r.cad_type, r.tone) for r in cadence.cadences(mei.note_events(rows), mei.metadata(rows)).collect()}
    assert found == {"phr.mei": ("Phrygian", "E"), "pla.mei": ("Plagal", "C")}


def test_analysis_of_a_document(ingest):
    body = "<section>" + measure(1, line("g4:480 a4:480 b4:480 c5:480", "a"), line("e3:960 d3:480 c3:480", "b")) + "</section>"
    events = mei.note_events(ingest(one=score(body)))
    harmonic = intervals.harmonic_intervals(events).orderBy("onset_ppq").collect()
    assert [r.value for r in harmonic] == ["m10", "P11", "M13", "P15"]
    tokens = notes.note_table(events).filter("part = 1").orderBy("onset_ppq").collect()
    assert [r.token for r in tokens] == ["G4", "A4", "B4", "C5"]
    items = sonority.low_line_items(sonority.sonorities(events)).orderBy("onset_ppq").collect()
    assert [r.item for r in items] == ["-M2_m10", "Held_P11", "-M2_M13", "Held_P15"]


def test_minimum_strength_without_a_metre_is_an_error(ingest):
    body = "<section>" + measure(1, line("g4:480 a4:480", "a"), line("e3:960", "b")) + "</section>"
    table = sonority.sonorities(mei.note_events(ingest(one=score(body))))
    assert sonority.low_line_items(table).filter("kept").count() == 2
    assert sonority.fallback_warnings(table).count() == 1
    with pytest.raises(Exception, match="minimum_beat_strength"):
        sonority.sonority_ngrams(sonority.low_line_items(table, 0.5), 1).collect()
