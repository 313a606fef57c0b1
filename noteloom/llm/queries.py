"""Queries of the corpus operators over the given tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import (
    bpe,
    collocations,
    exact_dedup,
    language_id,
    line_dedup,
    near_pieces,
    packing,
    personal_data,
    sentence_pieces,
    sharding,
    similar_pieces,
    web_text,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as score documents: a piece, its content, and the language of its text."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("piece_id"), F.col("text").alias("content"), F.col("lang").alias("language")
    )


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("piece_id"), F.col("embedding").alias("profile")
    )
    found = similar_pieces.similar_pieces(profiles, F.col("piece_id") % 20 == 0, k=20)
    return found.withColumnRenamed("piece_id", "vec_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    judged = index.append(_scores(spark, sf_dir)).withColumnRenamed("piece_id", "doc_id")
    index.drop()  # the query starts from nothing each time
    return judged


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_pieces.near_pieces(_scores(spark, sf_dir), width=4, percent=85)
    return linked.withColumnRenamed("piece_id", "doc_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    found = personal_data.find(scores, personal_data.fit(scores))
    return found.select(
        F.col("piece_id").alias("doc_id"),
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_pieces(_scores(spark, sf_dir), shards=16)
    return placed.select(
        F.col("piece_id").alias("doc_id"),
        F.col("n_bytes").alias("size"),
        F.col("content_crc32").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(
        _scores(spark, sf_dir), line_dedup.LineRuns(spark), min_pieces=10, batches=line_dedup.FANOUT
    )
    return kept.select(
        F.col("piece_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_scores(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return coded.withColumnRenamed("piece_id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("piece_id").cast("string"), F.lit(""))) % 4 == 2
    scores = _scores(spark, sf_dir).withColumn("held_out", held_out)
    learned = scores.filter(~F.col("held_out"))
    model = language_id.fit(learned, learned)
    return language_id.predict(scores, model, carry=("held_out",)).select(
        F.col("piece_id").alias("doc_id"), "held_out", F.col("language_found").alias("lang_pred"), "score"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(
        _scores(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), special_id=50256, end_id=1
    )
    return packed.withColumnRenamed("piece_id", "doc_id")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.round_trip(_scores(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.withColumnRenamed("piece_id", "doc_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(_scores(spark, sf_dir), min_count=100, max_words=5, top=2000)
    return found.select(
        F.col("language").alias("lang"),
        "rank",
        "phrase",
        F.col("n_phrase").alias("a"),
        F.col("n_first").alias("l"),
        F.col("n_rest").alias("r"),
        F.col("n_words").alias("n"),
        "score",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("piece_id"), F.col("embedding").alias("profile")
    )
    return whitening.whiten(profiles, components=16).withColumnRenamed("piece_id", "vec_id")


QUERIES["op1_multi_index_hashing"] = op1_multi_index_hashing
QUERIES["op2_exact_dedup"] = op2_exact_dedup
QUERIES["op3_ngram_jaccard_join"] = op3_ngram_jaccard_join
QUERIES["op4_html_extraction"] = op4_html_extraction
QUERIES["op5_pii"] = op5_pii
QUERIES["op6_sharding"] = op6_sharding
QUERIES["op7_line_dedup"] = op7_line_dedup
QUERIES["op8_bpe"] = op8_bpe
QUERIES["op9_language_id"] = op9_language_id
QUERIES["op10_packing"] = op10_packing
QUERIES["op11_sentence_pieces"] = op11_sentence_pieces
QUERIES["op12_collocations"] = op12_collocations
QUERIES["op13_whitening"] = op13_whitening

_BLANK = "[\\x20\\x09-\\x0D]"

ORACLES["op2_exact_dedup"] = f"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') AS key
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER longest AS keep_id,
       count(*) OVER (PARTITION BY key) AS group_size,
       row_number() OVER longest = 1 AS kept,
       sha256(key) AS text_sha256
FROM texts
WINDOW longest AS (PARTITION BY key ORDER BY n DESC, doc_id NULLS FIRST)
"""

ORACLES["op7_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT *, key IN (SELECT key FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op12_collocations"] = """
WITH pieces AS (
  SELECT row_number() OVER () AS id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents)),
numbered AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, size, words[place : place + size - 1] AS gram
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS place FROM numbered WHERE len(words) > 0), range(1, 6) AS sizes(size)
  WHERE place + size - 1 <= len(words)),
counts AS (
  SELECT lang, size, array_to_string(gram, ' ') AS phrase, any_value(gram) AS words, count(*)::HUGEINT AS f
  FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE size > 1 AND f >= 100),
inner_parts AS (
  SELECT c.lang, array_to_string(c.words[place : place + length - 1], ' ') AS phrase, max(c.f) AS longer
  FROM candidates c, range(2, 5) AS lengths(length), range(1, 5) AS places(place)
  WHERE length < c.size AND place + length - 1 <= c.size GROUP BY ALL),
own AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_parts i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.f),
cuts AS (
  SELECT o.lang, o.phrase, o.f AS a, k, l.f AS l, r.f AS r, t.n, (1000 * o.f * t.n) // (l.f * r.f) AS score
  FROM own o JOIN range(1, 5) AS ks(k) ON k < o.size
  JOIN counts l ON l.lang = o.lang AND l.phrase = array_to_string(o.words[1 : k], ' ')
  JOIN counts r ON r.lang = o.lang AND r.phrase = array_to_string(o.words[k + 1 : o.size], ' ')
  JOIN totals t ON t.lang = o.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
