"""Stored intermediate tables: rebuilt when their input changes, deleted on request, never done without."""

import os

import pytest
from noteloom.sources import tables


def test_changed_input_is_stored_again(spark, tmp_path):
    path = str(tmp_path / "numbers")

    def total():
        df = tables.stored_once(spark, f"numbers:{path}", lambda: spark.read.parquet(path), path)
        return df.agg({"id": "sum"}).head()[0]

    spark.range(5).write.parquet(path)
    assert total() == 10
    spark.range(7).write.mode("overwrite").parquet(path)
    assert total() == 21


def test_unchanged_input_makes_no_plan(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(0, 8, 1, 4).write.parquet(path)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(path)

    for _ in range(3):
        assert tables.stored_once(spark, f"once:{path}", build, path).count() == 8
    assert len(built) == 1
    spark.range(1).write.mode("append").parquet(path)
    assert tables.stored_once(spark, f"once:{path}", build, path).count() == 9


def test_no_shared_folder_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.store(spark.range(1), "x")


def test_clear_deletes_stored_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: str(tmp_path))
    assert tables.store(spark.range(3), "x").count() == 3
    tables.stored_once(spark, "cleared", lambda: spark.range(4))
    assert os.listdir(tmp_path / "noteloom")
    tables.clear(spark)
    assert not os.listdir(tmp_path / "noteloom")
    assert tables.stored_once(spark, "cleared", lambda: spark.range(4)).count() == 4
