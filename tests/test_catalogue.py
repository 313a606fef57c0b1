"""Catalogue, streaming registration and sinks."""

import json

import pytest
from documents import measure, note, score
from pyspark.sql import functions as F

from noteloom.operators import ngrams, notes
from noteloom.sources import catalogue, mei, sinks
from noteloom.streaming.registration import register_arrivals, register_files, registered_scores, unregister_files, with_registered


@pytest.fixture
def scores(spark):
    rows = [
        ("Bach_1.mei", "/b/1", "builtin", 0),
        ("CRIM_1.mei", "/b/2", "builtin", 0),
        ("Other.mei", "/b/3", "builtin", 0),
        ("Bach_1.mei", "/r/1", "registered", 1),
        ("Bach_1.mei", "/r/0", "registered", 2),
        ("Mine.mei", "/r/2", "registered", 1),
    ]
    return spark.createDataFrame(rows, "filename string, path string, source string, registered_at bigint")


def test_collections(scores):
    listed = {}
    for row in catalogue.collections(scores, ordered=True).collect():
        listed.setdefault(row.collection, []).append(row.filename)
    assert listed == {
        "bach_inventions": ["Bach_1.mei"],
        "crim_corpus": ["CRIM_1.mei"],
        "uploaded_mei_files": ["Bach_1.mei", "Mine.mei"],
        "all_files": ["Bach_1.mei", "CRIM_1.mei", "Mine.mei", "Other.mei"],
    }
    assert json.loads(catalogue.as_json(scores, ordered=True).first().record) == {"collection": "all_files", "filename": "Bach_1.mei"}


def test_registered_scores_shadow_builtin_ones(scores):
    chosen = {r.filename: r.path for r in catalogue.resolve(scores).collect()}
    assert chosen == {"Bach_1.mei": "/r/0", "CRIM_1.mei": "/b/2", "Other.mei": "/b/3", "Mine.mei": "/r/2"}


def test_unregister(spark, scores):
    left = catalogue.unregister(scores, spark.createDataFrame([("Bach_1.mei",), ("CRIM_1.mei",)], "filename string"))
    assert sorted(r.path for r in left.collect()) == ["/b/1", "/b/2", "/b/3", "/r/2"]


def test_piece_list(spark):
    got = catalogue.named_pieces(spark, "b", ["a", "", "b", "c", "a"]).collect()
    assert sorted((r.score_index, r.piece_id) for r in got) == [(0, "b"), (1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        catalogue.named_pieces(spark, None, [""])


def test_registration_stream(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()
    good = score("<section>" + measure(1, note("c4", 480)) + "</section>")
    (inbox / "a.mei").write_text(good)
    (inbox / "broken.mei").write_text("<mei>")

    def run():
        register_arrivals(spark, str(inbox), str(out), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(out / "scores")), spark.read.parquet(str(out / "rejected"))

    accepted, rejected = run()
    assert [r.filename for r in accepted.collect()] == ["a.mei"]
    assert rejected.first().error.startswith("not well-formed XML")
    (inbox / "b.mei").write_text(good)
    accepted, rejected = run()
    assert sorted(r.filename for r in accepted.collect()) == ["a.mei", "b.mei"]
    assert rejected.count() == 1
    assert {r.source for r in accepted.collect()} == {"registered"}
    elements = spark.read.parquet(str(out / "elements"))
    assert elements.filter("kind = 'event'").count() == 2


def test_registered_files_replace_builtin_ones(spark, tmp_path):
    def piece(name):
        return score("<section>" + measure(1, note(name, 480)) + "</section>")

    shelf, mine, out = tmp_path / "shelf", tmp_path / "mine", str(tmp_path / "out")
    for folder, names in ((shelf, {"a": "c4", "b": "d4"}), (mine, {"x": "e4", "y": "f4"})):
        folder.mkdir()
        for name, pitch in names.items():
            (folder / f"{name}.mei").write_text(piece(pitch))
    builtin = mei.elements(mei.read_documents(spark, str(shelf)))
    register_files(spark, str(mine / "x.mei"), out, "one", "a.mei")
    register_files(spark, str(mine / "y.mei"), out, "two")
    register_files(spark, str(mine / "y.mei"), out, "three", "no/good.mei")

    def pitches():
        events = mei.note_events(with_registered(builtin, out))
        return {r.piece_id: r.midi for r in events.collect()}

    assert pitches() == {"a.mei": 64, "b.mei": 62, "y.mei": 65}
    register_files(spark, str(mine / "y.mei"), out, "four", " a.mei ")
    assert pitches()["a.mei"] == 65
    assert sorted(r.filename for r in registered_scores(spark, out).collect()) == ["a.mei", "y.mei"]
    rejected = spark.read.parquet(f"{out}/rejected").collect()
    assert [r.error for r in rejected] == ["the file name may not be a path"]


def test_names_are_settled_before_flattening(spark, tmp_path):
    good = score("<section>" + measure(1, note("c4", 480)) + "</section>")
    out = str(tmp_path / "out")
    for folder, name in (("one", " a .mei"), ("two", "a .mei"), ("two", "b.mei")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(good)
    register_files(spark, str(tmp_path / "one" / " a .mei"), out, "one")
    (row,) = spark.read.parquet(f"{out}/elements").filter("kind = 'event'").collect()
    assert row.piece_id == "a .mei" == registered_scores(spark, out).first().filename
    register_files(spark, f"{tmp_path}/{{one,two}}", out, "two")
    rejected = spark.read.parquet(f"{out}/rejected").filter("batch = 'two'").collect()
    assert [(r.filename, r.error) for r in rejected] == [("a .mei", "2 files of this batch claim the name")] * 2
    assert registered_scores(spark, out).count() == 2
    with pytest.raises(ValueError, match="several"):
        register_files(spark, str(tmp_path / "two"), out, "three", "c.mei")
    with pytest.raises(ValueError, match="batch name"):
        register_files(spark, str(tmp_path / "two"), out, "../x")


def test_removal_from_the_stored_registry(spark, tmp_path):
    good = score("<section>" + measure(1, note("c4", 480)) + "</section>")
    (tmp_path / "a.mei").write_text(good)
    (tmp_path / "b.mei").write_text(good)
    out = str(tmp_path / "out")
    register_files(spark, f"{tmp_path}/*.mei", out, "one")
    unregister_files(spark, out, [" a.mei "], "gone")
    assert [r.filename for r in registered_scores(spark, out).collect()] == ["b.mei"]
    register_files(spark, str(tmp_path / "a.mei"), out, "two")
    assert registered_scores(spark, out).count() == 2


def test_equal_names_in_two_folders_are_two_pieces(spark, tmp_path):
    for folder in ("", "x", "y"):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "Bach_1.mei").write_text(score(""))
    found = mei.read_documents(spark, str(tmp_path)).select("piece_id", catalogue.collection_of(F.col("piece_id"))).collect()
    assert {r[0] for r in found} == {"Bach_1.mei", "x/Bach_1.mei", "y/Bach_1.mei"} and {r[1] for r in found} == {"bach_inventions"}


def test_long_piece_lists(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "STRIP_BLOCKS", 3)
    names = spark.createDataFrame([(3 * k, f"p{k % 70}") for k in range(200)], "pos bigint, name string")
    got = catalogue.piece_list(names, block_rows=4).collect()
    assert sorted((r.score_index, r.piece_id) for r in got) == [(k, f"p{k}") for k in range(70)]


def test_wide_names_its_strays_and_long_undoes_it(spark):
    table = spark.createDataFrame([(1, 1, "c"), (1, 2, "d"), (2, 1, "e")], "at int, part int, token string")
    wide = sinks.wide(table, ["at"], "part", "token", [1, 2])
    back = sinks.long(wide, ["at"], ["1", "2"], "part", "token")
    assert sorted(map(tuple, back.collect())) == [(1, "1", "c"), (1, "2", "d"), (2, "1", "e")]
    with pytest.raises(Exception, match="not among the columns: 2"):
        sinks.wide(table, ["at"], "part", "token", [1]).collect()


def test_wide_csv(spark, events, tmp_path):
    table = notes.note_table(events)
    wide = sinks.wide(table, ["piece_id", "measure", "beat", "onset_ppq"], "part", "token", [1, 2, 3, 4, 5])
    path = str(tmp_path / "wide")
    sinks.write_csv(wide, path, "notes", ["piece_id", "onset_ppq"])
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["piece_id", "measure", "beat", "onset_ppq", "1", "2", "3", "4", "5"]
    assert back.count() == table.select("piece_id", "onset_ppq").distinct().count()
    sinks.write_csv(wide.filter("false"), path, "notes")
    assert spark.read.text(path).first()[0] == "No notes found"


def test_stored_corpus_is_pruned(spark, events, tmp_path):
    named = events.withColumn("piece_id", F.concat(F.lit("Bach_"), "piece_id")).unionByName(events)
    path = str(tmp_path / "corpus")
    sinks.write_events(named, path)
    back = sinks.read_events(spark, path)
    assert back.count() == 2 * events.count()
    one = back.filter("collection = 'bach_inventions' and piece_id = 'Bach_u1'").select("midi")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "collection" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(piece_id,Bach_u1)" in plan
    assert one.count() == events.filter("piece_id = 'u1'").count()


def test_json_payload(spark, events, tmp_path):
    found = ngrams.melodic_ngrams(events, 3)
    sinks.write_json({"counts": ngrams.count_patterns(found), "matches": ngrams.matches(found, ["2_2_2"])}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "counts")).count() == found.select("piece_id", "pattern_string").distinct().count()
    assert spark.read.json(str(tmp_path / "matches")).count() == found.filter("pattern_string = '2_2_2'").count()
