"""What ingest of many documents must not cost: rows moved for nothing, collections of rows that wait, passes over lines."""

import gc

import pyarrow as pa
import pytest
from documents import line, measure, note, score

from noteloom.operators import notes, repeats
from noteloom.plans import projection
from noteloom.sources import mei
from noteloom.sources.tables import store


@pytest.fixture
def stored(spark):
    def run(**documents):
        rows = [(name, text.encode()) for name, text in documents.items()]
        return store(mei.elements(spark.createDataFrame(rows, "piece_id string, content binary")), "scale")

    return run


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_parts_with_ties_are_merged(stored, monkeypatch):
    merged = []
    monkeypatch.setattr(mei, "merge_ties", lambda events, *more: merged.append(events) or notes.merge_ties(events, *more))
    tie = note("c4", 480, "a1") + note("c4", 480, "a2", 'tie="t"') + note("d4", 480, "a3")
    rows = stored(
        free=score("<section>" + measure(1, line("c4:480 d4:480", "x")) + "</section>"),
        held=score("<section>" + measure(1, line("c4:480 -:480 d4:480", "y"), tie) + "</section>"),
    )
    found = mei.note_events(rows)
    assert {(r.piece_id, r.part) for r in merged[0].collect()} == {("held", 2)}
    columns = ["piece_id", "part", "seq", "note_place", "onset_ppq", "dur_ppq", "note_ids"]
    assert {(*r[:6], tuple(r[6] or ())) for r in found.select(columns).collect()} == {
        ("free", 1, 1, 0, 0, 480, ("x1",)), ("free", 1, 2, 1, 480, 480, ("x2",)),
        ("held", 1, 1, 0, 0, 480, ("y1",)), ("held", 1, 2, None, 480, 480, ()), ("held", 1, 3, 1, 960, 480, ("y3",)),
        ("held", 2, 1, 0, 0, 960, ("a1", "a2")), ("held", 2, 2, 1, 960, 480, ("a3",)),
    }


def test_ties_reach_over_sections_rests_and_layers(stored):
    def tied(id, name="c4"):
        return note(name, 480, id, 'tie="t"')

    layers = '<staff n="1"><layer n="1">{}</layer><layer n="2">{}</layer></staff>'.format
    body = (
        '<section><measure n="1">' + layers(note("c4", 480, "a"), note("e4", 480, "x")) + "</measure></section>"
        '<section><measure n="2">' + layers(tied("b"), tied("y", "f4") + tied("z", "f4")) + "</measure>"
        + measure(3, '<rest dur.ppq="480"/>' + tied("c") + '<chord dur.ppq="480"><note pname="c" oct="4" tie="t" xml:id="d"/>'
                  '<note pname="a" oct="3" xml:id="e"/></chord>') + "</section>"
    )
    found = mei.note_events(stored(one=score(body))).orderBy("part", "seq").collect()
    assert [(r.part, r.seq, r.note_ids, r.dur_ppq, r.section_start) for r in found] == [
        (1, 1, ["a", "b"], 960, True), (1, 2, None, 480, False), (1, 3, ["c", "d", "e"], 960, False),
        (2, 1, ["x"], 480, True), (2, 2, ["y", "z"], 960, True),
    ]


def test_batches_hold_one_kind_and_waiting_rows_are_not_collected():
    text = score("<section>" + measure(1, line("c4:480 d4:480", "a")) + "</section>").encode()
    names = [f"d{i}" for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([text] * len(names))], names=["piece_id", "content"])
    collections = []
    gc.callbacks.append(lambda phase, info: collections.append(phase))
    try:
        found = list(mei._flatten_batches(iter([batch])))
    finally:
        gc.callbacks.pop()
    assert gc.isenabled() and len(collections) < 20
    assert all(len(set(b.column("kind").to_pylist())) == 1 for b in found)
    table = pa.Table.from_batches(found)
    assert table.schema == mei._ARROW and set(table.column("piece_id").to_pylist()) == set(names)
    heads = next(b for b in found if b.column("kind")[0].as_py() == "head")
    assert heads.column("notes").null_count == heads.num_rows and heads.column("written").null_count == heads.num_rows


def test_names_without_namespace_keep_their_order_and_the_first_counts():
    text = (
        b'<mei xmlns:u="v"><music><section><measure n="1"><staff n="1"><layer><note u:dur="2" dur="4" tie="t">'
        b'<accid accid="s"/><accid accid="f"/></note><rest dur="8" u:dur="1"/></layer></staff></measure></section></music></mei>'
    )
    _, first, second, _ = mei._batch(mei.flatten_document(text, "p")).to_pylist()
    assert first["notes"] == [[("dur", "2"), ("dur", "4"), ("tie", "t"), ("child.accid", "s")]] and first["attrs"] is None
    assert (first["written"]["ticks"], second["written"]["ticks"]) == (960, 240)
    assert second["attrs"] == [("dur", "8"), ("dur", "1")] and second["notes"] == []


def test_a_document_is_written_in_one_pass_over_its_lines(spark, sf_dir):
    plan = plan_of(projection.score_documents(spark, sf_dir))
    assert "filter(" not in plan and plan.count("collect_list") == 2


def test_the_performed_order_is_made_once(stored):
    body = "<section>" + "".join(
        measure(n, note("c4", 480), attrs=signs) for n, signs in enumerate(("", 'left="rptstart"', 'right="rptend"', ""), 1)
    ) + "</section>"
    rows = stored(one=score(body))
    order = repeats.performed_order(mei.measures(rows))
    played = repeats.performed_events(mei.note_events(rows), order, mei.timeline(rows))
    # Regions are spelled out in the job that stores the order with its lengths, not again in each pass over them.
    assert "Generate explode" in plan_of(order) and "Generate explode" not in plan_of(played)
    found = played.orderBy("performed_seq").select("measure_seq", "onset_ppq").collect()
    assert [tuple(r) for r in found] == [(m, 480 * k) for k, m in enumerate((1, 2, 3, 2, 3, 4))]
