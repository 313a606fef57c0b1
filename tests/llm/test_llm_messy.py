"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import uuid
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from noteloom.llm import (
    bpe,
    exact_dedup,
    language_id,
    line_dedup,
    near_pieces,
    packing,
    personal_data,
    sharding,
    similar_pieces,
    web_text,
)

LONG = "Kyrie eleison, Christe eleison. " * 20000
ROWS = [
    (1, "Gloria in excelsis Deo\nAmen", "la"),
    (1, "Gloria in excelsis Deo\nAmen", "la"),
    (2, None, None),
    (3, "", "la"),
    (None, "sine nomine", "la"),
    (4, LONG, "la"),
    (5, " \t\n", None),
    (6, "Gloria  in excelsis Deo Amen", "fr"),
]
CLASHES = (
    "row n label class group shard slot stripe spans base kept drops digest keep_id text_hi line_hi bucket score bin "
    "sequence_id length start language_found __text token_ids prefix set_hi"
).split()
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

def _index(spark):
    return exact_dedup.DigestIndex(spark, f"messy_digests_{uuid.uuid4().hex}", buckets=2)


OPERATORS = {
    "exact_dedup": lambda s, d: _index(s).append(d),
    "near_pieces": lambda s, d: near_pieces.near_pieces(d),
    "personal_data": lambda s, d: personal_data.find(d, personal_data.fit(d)),
    "sharding": lambda s, d: sharding.shard_pieces(d, 3, stripes=4),
    "line_dedup": lambda s, d: line_dedup.drop_common_lines(d, line_dedup.LineRuns(s), 2),
    "bpe": lambda s, d: bpe.round_trip(d, WORDS),
    "bpe_decode": lambda s, d: bpe.decode_pieces(bpe.encode_pieces(d, WORDS), WORDS),
    "language_id": lambda s, d: language_id.predict(d, language_id.fit(d, d)),
    "packing": lambda s, d: packing.pack(d, RANKS, 50256, 1),
}


@pytest.fixture(scope="module")
def messy(spark):
    rows = spark.createDataFrame(ROWS, "piece_id long, content string, language string")
    return rows.withColumns({name: F.lit("x") for name in CLASHES})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, messy, name):
    assert OPERATORS[name](spark, messy.limit(0)).collect() == []


def test_exact_dedup(spark, messy):
    rows = OPERATORS["exact_dedup"](spark, messy).collect()
    assert len(rows) == len(ROWS)
    of = {}
    for row in rows:
        of.setdefault(row["piece_id"], []).append(row)
    # The longest original stays, and of rows that repeat exactly one does.
    assert [r["keep_id"] for r in of[1]] == [6, 6] and of[6][0]["kept"] and of[6][0]["group_size"] == 3
    assert not any(r["kept"] for r in of[1])
    # Null, empty and blank texts are equal; the blank one is the longest.
    assert {of[i][0]["keep_id"] for i in (2, 3, 5)} == {5}
    assert of[2][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert of[4][0]["text_sha256"] == hashlib.sha256("".join(LONG.split()).encode()).hexdigest()
    assert sum(r["kept"] for r in rows) == 4


def test_repeated_rows_keep_one(spark):
    rows = spark.createDataFrame([(7, "Amen")] * 5, "piece_id long, content string")
    assert sum(r["kept"] for r in _index(spark).append(rows).collect()) == 1


def test_near_pieces(spark, messy):
    rows = sorted(OPERATORS["near_pieces"](spark, messy).collect(), key=str)
    assert len(rows) == len(ROWS)
    of = {r["piece_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert of == {1: (1, 1), 2: (0, 2), 3: (0, 3), None: (1, None), 4: (4, 4), 5: (0, 5), 6: (1, 1)}


def test_personal_data(spark, messy):
    assert {r["base"] for r in OPERATORS["personal_data"](spark, messy).collect()} == {""}


def test_sharding(spark, messy):
    rows = OPERATORS["sharding"](spark, messy).collect()
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["n_bytes"] for r in rows if r["piece_id"] in (2, 3)} == {1}
    assert len({r["shard"] for r in rows if r["piece_id"] == 1}) == 1


def test_line_dedup(spark, messy):
    rows = OPERATORS["line_dedup"](spark, messy).collect()
    of = {r["piece_id"]: r for r in rows}
    assert of[1]["kept"] == "" and of[1]["n_dropped"] == 2  # both rows count
    assert (of[2]["n_lines"], of[2]["n_dropped"], of[2]["kept"]) == (1, 0, "")
    assert of[5]["kept"] == " \t\n" and of[4]["kept"] == LONG


def test_bpe(spark, messy):
    of = {r["piece_id"]: r for r in OPERATORS["bpe"](spark, messy).collect()}
    assert of[2]["n_tokens"] == of[3]["n_tokens"] == of[5]["n_tokens"] == 0
    assert of[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_language_id(spark, messy):
    of = {r["piece_id"]: r for r in OPERATORS["language_id"](spark, messy).collect()}
    assert {of[i]["language_found"] for i in (2, 3, 5)} == {"und"} and of[2]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in of.values())


def test_packing(spark, messy):
    rows = OPERATORS["packing"](spark, messy).collect()
    assert sum(r["length"] for r in rows if r["piece_id"] == 2) == 1
    assert {r["ids_crc32"] for r in rows if r["piece_id"] == 3} == {zlib.crc32((1).to_bytes(4, "little"))}
    by_document = {}
    for r in rows:
        if r["piece_id"] == 4:
            by_document[r["start"]] = r["length"]
    assert sum(by_document.values()) == rows[[r["piece_id"] for r in rows].index(4)]["doc_tokens"]


def test_web_text(spark):
    pages = spark.createDataFrame(
        [(1, "u", None), (2, None, ""), (None, "v", "<p>Text"), (4, "w", "<p>Te&amp;xt</p>" * 3000), (4, "w", "x")],
        "page_id long, url string, html string",
    ).withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    rows = web_text.extract(pages).collect()
    assert [(r["page_id"], r["text"][:4], r["n_chars"]) for r in rows] == [
        (1, "", 0), (2, "", 0), (None, "Text", 4), (4, "Te&x", 3000 * 7 - 2), (4, "x", 1)
    ]
    assert web_text.extract(pages.limit(0)).collect() == []


def test_similar_pieces(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [])]
    profiles = spark.createDataFrame(rows, "piece_id long, profile array<double>").withColumn("class", F.lit(0))
    found = similar_pieces.similar_pieces(profiles, F.col("piece_id") < 4, k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [
        (1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)
    ]
    assert similar_pieces.similar_pieces(profiles.limit(0), F.lit(True)).collect() == []
