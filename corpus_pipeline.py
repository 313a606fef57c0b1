"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor left, written as Parquet and read
again. All but the last return the columns of ``documents``; where a stage
changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import language_id, line_dedup, near_pieces, packing, personal_data
from noteloom.llm.columns import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document stays when its language is found with at least this probability.
LEAST_SCORE = 0.5


def _scores(docs: DataFrame) -> DataFrame:
    """Documents as score documents, each with the rest of its row; its text goes to Python and back once."""
    others = F.struct(*[name for name in docs.columns if name != "text"])
    return docs.select(
        F.col("doc_id").alias("piece_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.struct(others.alias("others"), F.col("text").isNull().alias("no_text")).alias("row"),
    )


def _with_text(found: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The rows with another text; a null text stays null."""
    changed = found.select("row.others.*", F.when(~F.col("row.no_text"), text).alias("__text"))
    return changed.select(*[
        F.col("__text").alias("text") if name == "text"
        else F.char_length("__text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if name == "n_chars"
        else F.col(name)
        for name in docs.columns
    ])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or with no likely language go."""
    scores = _scores(docs)
    found = language_id.predict(scores, language_id.fit(scores, scores), carry=("row", "content"))
    kept = (F.col("language_found") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.filter(kept).select("row.others.*", F.col("content").alias("text")).select(*docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them share; emptied ones stay, empty."""
    runs = line_dedup.LineRuns(spark)
    kept = line_dedup.drop_common_lines(_scores(docs), runs, min_pieces=10, carry=("row",))
    return _with_text(kept, docs, F.col("kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, whole rows that repeat once.

    Documents without words are nobody's copy and stay.
    """
    key = {"__hi": F.xxhash64("text"), "__lo": F.xxhash64(F.lit(1), "text")}
    keyed = docs.withColumns(key)
    scores = keyed.select(F.struct("doc_id", *key).alias("piece_id"), F.col("text").alias("content"))
    linked = near_pieces.near_pieces(scores, width=5, percent=80)
    first = linked.filter(F.col("piece_id").eqNullSafe(F.col("component_id"))).select("piece_id.*").distinct()
    first = stored(first.withColumnRenamed("doc_id", "__id"), "kept-pieces")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (keyed["__hi"] == first["__hi"]) & (keyed["__lo"] == first["__lo"])
    return keyed.join(first, same, "left_semi").dropDuplicates(["doc_id", *key]).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind."""
    scores = _scores(docs)
    found = personal_data.find(scores, personal_data.fit(scores), carry=("row",))
    return _with_text(found, docs, F.col("redacted"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 2,048 ids."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = packing.pack(_scores(docs), ranks, special_id=50256, end_id=1)
    return pieces.withColumnRenamed("piece_id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", without_common_lines),
    ("near_pieces", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Several stages learn models, which SQL cannot express; the tests use a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
