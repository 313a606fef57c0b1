"""The registry's log: tries that die, batches run again, several writers."""

import threading

import pytest

from noteloom.sources import catalogue, mei
from noteloom.streaming import registration
from noteloom.streaming.registration import RegistryLog, register_files, registered_scores, unregister_files, with_registered

SCORE = '<mei xmlns="http://www.music-encoding.org/ns/mei"><music><body/></music><!--{}--></mei>'


def write(folder, name, note=""):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(SCORE.format(note))
    return str(folder / name)


def names(spark, out):
    return sorted(r.filename for r in registered_scores(spark, out).collect())


def test_a_try_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    out, path = str(tmp_path / "out"), write(tmp_path / "in", "a.mei")
    assert names(spark, out) == []
    with monkeypatch.context() as broken:
        broken.setattr(RegistryLog, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            register_files(spark, path, out, "one")
    assert names(spark, out) == []
    register_files(spark, path, out, "one")
    assert names(spark, out) == ["a.mei"]
    builtin = mei.elements(mei.read_documents(spark, str(tmp_path / "in")))
    states = mei.scores(with_registered(builtin, out)).collect()
    assert [(r.piece_id, r.is_valid) for r in states] == [("a.mei", True)]


@pytest.mark.parametrize("table", ["scores", "rejected"])
def test_killed_between_its_writes(spark, tmp_path, monkeypatch, table):
    out, path = str(tmp_path / "out"), write(tmp_path / "in", "a.mei")
    real = catalogue.registrations

    def dying(candidates):
        accepted, rejected = real(candidates)
        broken = accepted.selectExpr("*", "raise_error('killed') as x").select(*accepted.columns, "x")
        return (broken, rejected) if table == "scores" else (accepted, broken)

    with monkeypatch.context() as broken:
        broken.setattr(catalogue, "registrations", dying)
        with pytest.raises(Exception, match="killed"):
            register_files(spark, path, out, "one")
    assert RegistryLog(spark, out).entries().count() == 0 and names(spark, out) == []
    register_files(spark, path, out, "one")
    assert names(spark, out) == ["a.mei"]


def test_an_old_batch_run_again_after_a_removal(spark, tmp_path):
    out, path = str(tmp_path / "out"), write(tmp_path / "in", "a.mei")
    register_files(spark, path, out, "one")
    unregister_files(spark, out, ["a.mei"], "gone")
    register_files(spark, path, out, "one")
    assert names(spark, out) == []
    unregister_files(spark, out, ["a.mei"], "gone")
    register_files(spark, path, out, "again")
    assert names(spark, out) == ["a.mei"]
    unregister_files(spark, out, ["a.mei"], "gone")  # done before, and not done again
    assert names(spark, out) == ["a.mei"]
    assert [r.number for r in RegistryLog(spark, out).entries().orderBy("number").collect()] == [1, 2, 3]


def test_several_writers(spark, tmp_path):
    """Each batch gets one number, also when two writers try the same batch."""
    out = str(tmp_path / "out")
    log = RegistryLog(spark, out)
    given = []

    def writer(batch):
        given.append(log.commit(batch, f"{batch}-{threading.get_ident()}"))

    threads = [threading.Thread(target=writer, args=(f"b{i % 6}",)) for i in range(12)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    rows = log.entries().collect()
    assert sorted(r.batch for r in rows) == [f"b{i}" for i in range(6)] and len({r.number for r in rows}) == 6
    assert {r.number for r in rows} <= {n for n in given if n is not None}
    (tmp_path / "out" / "log" / "000000000099.json").write_text("")  # a writer that died
    assert log.entries().count() == 6 and log.commit("later", "x") == 100


def test_latest_changes(spark):
    rows = [("a", 1, True, "x"), ("a", 3, True, "y"), ("b", 1, True, "x"), ("b", 2, False, None), ("c", 5, False, None),
            ("d", 4, True, "p"), ("d", 4, False, None)]
    changes = spark.createDataFrame(rows, "filename string, number long, added boolean, path string")
    assert [(r.filename, r.path) for r in catalogue.latest_changes(changes).collect()] == [("a", "y")]
