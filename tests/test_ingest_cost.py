"""What ingest costs: shuffles of the document table, and columns instead of a dictionary for each row."""

import subprocess
import sys

import pyarrow as pa
from pyspark import cloudpickle

from noteloom.plans import projection
from noteloom.sources import mei


def test_lines_of_a_document_are_shuffled_once(spark, sf_dir):
    plan = projection.score_documents(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan


def test_rows_are_as_wide_as_the_table_and_keep_missing_values():
    text = (
        b'<mei><meiHead><title xmlns:u="v" u:type="a"> T </title></meiHead><music><section><measure n="3">'
        b'<staff n="1"><layer><tuplet num="3" numbase="2"><note dur="4"/></tuplet><rest/></layer></staff>'
        b"</measure></section></music></mei>"
    )
    rows = mei.flatten_document(text, "p") + mei.flatten_document(b"<html/>", "q")
    assert {len(row) for row in rows} == {len(mei._ARROW)}
    batch = mei._batch(rows)
    batch.validate(full=True)
    score, head, note, rest, measure, bad = batch.to_pylist()
    assert (head["tag"], head["text"], head["attrs"]) == ("mei/meiHead/title", "T", [("type", "a")])
    assert note["notes"] == [[("dur", "4")]] and rest["notes"] == [] and measure["notes"] is None
    assert (note["num"], note["written"], note["encoded"]["ticks"]) == (3, {"ticks": 320, "start": 0, "earlier": 0}, 0)
    assert measure["written"] == {"ticks": 320, "start": 0, "earlier": 0} and score["written"] is None
    assert score["attrs"] is None and bad["text"].startswith("not a score")
    assert pa.Table.from_batches([batch]).schema == mei._ARROW


def test_the_walk_travels_without_the_package(tmp_path):
    (tmp_path / "walk").write_bytes(cloudpickle.dumps(mei._flatten_batches))
    code = "import pickle, sys; pickle.load(open('walk', 'rb')); assert 'noteloom' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": ""}, check=True, timeout=60)


def test_metadata_gathers_one_list_a_piece_of_the_rows_it_can_be_asked_for(spark, tmp_path):
    head = (
        "<mei><meiHead><fileDesc><titleStmt><title/><title>Second</title><respStmt><persName role='composer'>A</persName>"
        "<persName role='Composer'>B</persName><persName role='singer'>C</persName></respStmt></titleStmt>"
        "<pubStmt><date>1700</date><date isodate='1701-01-01'/></pubStmt></fileDesc></meiHead></mei>"
    )
    documents = spark.createDataFrame([("one", head.encode()), ("bare", b"<mei/>"), ("bad", b"<mei>")], "piece_id string, content binary")
    mei.elements(documents).write.parquet(str(tmp_path / "rows"))
    found = mei.metadata(spark.read.schema(mei.ELEMENTS).parquet(str(tmp_path / "rows")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "max_by" not in plan and plan.count("collect_list") == 2
    rows = {r.piece_id: r for r in found.collect()}
    assert set(rows) == {"one", "bare"} and rows["bare"].analysts == [] and rows["bare"].composer is None
    assert (rows["one"].title, rows["one"].composer, rows["one"].publication_date) == (None, "B", None)
