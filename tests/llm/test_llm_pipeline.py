"""The pipeline's stages and whole against plain versions, and the guard of the entry."""

import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from test_llm_operators import brute_components, brute_spans, lowered

from pyspark.sql import functions as F

REPO = Path(corpus_pipeline.__file__).parent
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_five_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_pieces", "personal_data", "packing"
    ]


def test_language_stage_keeps_clean_documents(spark, docs, sf_dir):
    kept = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.98 * docs.count()
    junk = spark.createDataFrame([(-1, "12 34 !!", "en", "s", 8), (-2, None, "en", "s", 0)], SCHEMA)
    ids = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.select(*junk.columns).union(junk), sf_dir).collect()}
    assert not ids & {-1, -2}


def test_line_stage(spark, docs, sf_dir):
    rows = {r["doc_id"]: r for r in docs.collect()}
    keys = {i: [lowered(line.strip(" \t\n\x0b\x0c\r")) for line in r["text"].split("\n")] for i, r in rows.items()}
    many = Counter(key for lines in keys.values() for key in set(lines) if key)
    for r in corpus_pipeline.without_common_lines(spark, docs, sf_dir).collect():
        lines = rows[r["doc_id"]]["text"].split("\n")
        want = "\n".join(line for line, key in zip(lines, keys[r["doc_id"]], strict=True) if many[key] < 10)
        assert (r["text"], r["n_chars"], r["lang"]) == (want, len(want), rows[r["doc_id"]]["lang"])


def test_near_stage_keeps_one_of_each_group(spark, docs, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    want = {i for i, (_, component) in brute_components(texts, 5, 80).items() if i == component}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_near_stage_with_repeated_ids_and_nulls(spark, sf_dir):
    rows = [(1, "a b c d e f", "en", "s", 11)] * 3 + [(1, "other words are in this one", "en", "s", 3),
            (None, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0)]
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(
        ["(None, 'a b c d e f')", "(1, 'other words are in this one')", "(2, None)", "(3, '')"]
    )


def test_personal_stage(spark, docs, sf_dir):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.without_personal_data(spark, docs, sf_dir).collect():
        assert brute_spans(r["text"]) == []
        if not re.search(r"[0-9@]", before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])


def test_stages_run_on_empty_tables_and_extra_columns(spark, docs, sf_dir):
    odd = docs.limit(3).withColumns({"row": F.lit(1), "kept": F.lit("x"), "spans": F.lit("y"), "__row": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns
        assert stage(spark, odd.limit(0), sf_dir).collect() == []
    assert corpus_pipeline.packed(spark, odd.limit(0), sf_dir).collect() == []


def test_run_packs_what_its_stages_keep(spark, docs, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in rows}
    assert 0.5 * len(texts) < len(kept) < len(texts) and kept <= set(texts)
    starts = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == starts.get(r["doc_id"], 0)
        starts[r["doc_id"]] = r["start"] + r["length"]
    assert all(starts[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_entry_works_without_the_corpus_package(tmp_path):
    for name in ("__spark_entry__.py", "noteloom"):
        source = REPO / name
        if source.is_dir():
            import shutil

            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            (tmp_path / name).write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[1:] == ["False", "True"], said.stderr
