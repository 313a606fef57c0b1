"""Sentence pieces against their library, phrases against counting by hand, whitened profiles against an eigendecomposition."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import connect, difference
from pyspark.sql import functions as F

from noteloom.llm import collocations, sentence_pieces, whitening
from noteloom.llm.queries import ORACLES, QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b ", " x", "ﬁ Ǻ é\t\n ½", "▁a", "\0", "日本語𝔘", "<s> <0x0A> </s>", "\xa0x", " " * 70 + "x", "aaaaaaa" * 9,
       "abababababab", "\n\n\n", "▁▁ ▁", " \n ", "x" * 500, "🎉👨‍👩‍👧 Kyrie"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return sentence_pieces.PieceEncoder(MODEL)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_pieces_are_those_of_the_library(codec, library):
    rng = random.Random(11)
    pool = "abcdeéñ ß▁  \t\n0123.,<>/ŒœА本語日😀́� "
    texts = ODD + ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choices("etaoinshrdlu ", k=rng.randint(1, 300))) for _ in range(1000)]
    texts += ["".join(rng.choices(" ab", k=rng.randint(1, 60))) for _ in range(2000)]
    want = library.encode(texts)
    got = codec.encode(texts)
    assert [ids_of(ids) for ids in got] == want
    assert [codec.decode(ids) for ids in got] == [library.decode(ids) for ids in want]
    assert codec.encode(texts) == got  # words that are known already


def test_any_ids_decode_as_in_the_library(codec, library):
    rng = random.Random(12)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(codec.n_ids), rng.randrange(261)]) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_long_words_and_ordered_merges(codec, library):
    letters = "".join(random.Random(13).choices("abcdefghijklmnopqrstuvwxyz", k=20000))
    for text in (letters, " " * 20000, "ab" * 10000, " x" * 9000):
        assert ids_of(codec.encode([text])[0]) == library.encode(text)


def test_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr(sentence_pieces, "CACHE_BYTES", 2000)
    small = sentence_pieces.PieceEncoder(MODEL)
    texts = [f"opus{i} number{i % 7} " + "y" * 100 for i in range(200)]
    assert [ids_of(small.encode([text])[0]) for text in texts] == library.encode(texts)
    assert small._held < 2000 + 20 * 300


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        data = file.read()
    broken = tmp_path / "unigram.model"
    broken.write_bytes(data + b"\x12\x02\x18\x01")  # a later training part with another kind of model
    with pytest.raises(ValueError, match="byte pairs"):
        sentence_pieces.PieceEncoder(str(broken))


def test_query_has_the_digests_of_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op11_sentence_pieces"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_slices_keep_every_document(spark, monkeypatch, library):
    scores = spark.createDataFrame([(i, text) for i, text in enumerate(ODD * 2)], "piece_id long, content string")
    coded = sentence_pieces.encode_pieces(scores, MODEL)
    assert [ids_of(r["token_ids"]) for r in coded.orderBy("piece_id").collect()] == library.encode(ODD * 2)
    back = sentence_pieces.decode_pieces(coded, MODEL).orderBy("piece_id").collect()
    assert [r["content"] for r in back] == [library.decode(ids) for ids in library.encode(ODD * 2)]


def counted(rows, min_count, max_words, top):
    """The contract of collocations, phrase by phrase."""
    counts, totals = defaultdict(Counter), Counter()
    for _, content, language in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in content or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            totals[language or "und"] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    counts[language or "und"][tuple(words[i : i + size])] += 1
    out = []
    for language, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows = []
        for phrase, a in candidates.items():
            inside = any(
                len(other) > len(phrase) and 100 * f[other] >= 100 * a
                and any(other[i : i + len(phrase)] == phrase for i in range(len(other)))
                for other in candidates
            )
            if not inside:
                n = totals[language]
                score, k = min((1000 * a * n // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
                rows.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]], n))
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(rows)[:top], 1):
            out.append((language, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def invented(seed, count=300):
    rng = random.Random(seed)
    words = ["gloria", "Gloria", "in", "excelsis", "deo", "et", "é", "amen", "\x1c", "ÿ", "a", "b", "c"]
    rows = []
    for i in range(count):
        text = "".join(rng.choice(words) + rng.choices([" ", "\t", "  ", ". ", ",", "\n", "\x0c"], (9, 1, 1, 1, 1, 1, 1))[0] for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice([text, "Gloria in excelsis Deo et b", "a a a a a a", None, ""]), rng.choice(["la", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("bits", [64, 10, 3])
def test_phrases_are_exact_with_and_without_collisions(spark, bits):
    rows = invented(7)
    scores = spark.createDataFrame(rows, "piece_id long, content string, language string").repartition(5)
    found = collocations.collocations(scores, min_count=9, max_words=4, top=25, fingerprint_bits=bits)
    assert sorted(tuple(r) for r in found.collect()) == counted(rows, 9, 4, 25)


def test_phrases_do_not_depend_on_slices(spark, monkeypatch):
    rows = invented(8)
    scores = spark.createDataFrame(rows, "piece_id long, content string, language string")
    counts = {tuple(r) for r in collocations.phrase_counts(scores.repartition(1), 12, 3).collect()}
    assert counts == {tuple(r) for r in collocations.phrase_counts(scores.repartition(40), 12, 3).collect()}
    assert counts


def test_large_counts_stay_exact():
    """Grams of many words: prefix sums wrap, the fingerprints of equal words do not."""
    numbers = np.array([1, 2, 3, 0, 1, 2, 3, 1, 2, 0])
    hashes = np.array([(0, 0), *np.random.default_rng(1).integers(0, 1 << 63, (3, 2))], np.uint64)
    grams = collocations._Grams(numbers, hashes, np.zeros(len(numbers), np.uint64))
    keys = grams.keys(2, 64)
    assert keys[0] == keys[4] == keys[7] != keys[1] and np.flatnonzero(grams.fits(3)).tolist() == [0, 4, 5, 6]


def test_op12_is_its_sql(spark, sf_dir):
    found = QUERIES["op12_collocations"](spark, "/root/testdata/sf0.01")
    assert difference(found, connect("/root/testdata/sf0.01"), ORACLES["op12_collocations"]) is None


def plain_axes(profiles, components):
    """Contract of whitening by an eigendecomposition of the whole covariance."""
    x = np.floor(64 * np.array(profiles, float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), (n * x - sums) / n @ axes / np.sqrt(values), values / (centred**2).sum() * n


def whitened_rows(found):
    out = defaultdict(dict)
    for row in found.collect():
        out[row["piece_id"]][row["component"]] = row
    return out


def close(found, ids, profiles, components):
    n, deviations, want, explained = plain_axes(profiles, components)
    rows = whitened_rows(found)
    assert sorted(rows) == sorted(ids)
    got = np.array([[rows[i][c]["whitened"] for c in range(1, want.shape[1] + 1)] for i in ids])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-9
    for i, deviation in zip(ids, deviations.tolist(), strict=True):
        for c in range(1, want.shape[1] + 1):
            row = rows[i][c]
            assert row["n"] == n and row["deviation"] == deviation and row["identity_error"] < 1e-9
            assert abs(row["explained"] - explained[c - 1]) < 1e-12


def test_axes_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(4)
    profiles = (rng.standard_normal((400, 9)) * [5, 3, 2, 1, 1, 0.7, 0.5, 0.4, 0.3] @ rng.standard_normal((9, 9))).tolist()
    profiles += profiles[:100] + [profiles[0]] * 200  # copies weigh once
    table = spark.createDataFrame(list(enumerate(profiles)), "piece_id long, profile array<double>").repartition(7)
    close(whitening.whiten(table, 5), range(len(profiles)), profiles, 5)


def test_op13_is_an_eigendecomposition(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    found = QUERIES["op13_whitening"](spark, sf_dir).withColumnRenamed("vec_id", "piece_id")
    close(found, [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 16)


def test_repeated_and_missing_variances(spark):
    """Equal variances are all found, axes without variance are left out."""
    corners = [[float(a), float(b), float(c), float(a + b), 7.0] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    table = spark.createDataFrame(list(enumerate(corners)), "piece_id long, profile array<double>")
    rows = whitened_rows(whitening.whiten(table, 16))
    assert {len(parts) for parts in rows.values()} == {3}
    values = np.array([[rows[i][c]["whitened"] for c in (1, 2, 3)] for i in range(8)])
    assert np.abs(values.T @ values / 8 - np.eye(3)).max() < 1e-12
    cube = [[float(a), float(b), float(c)] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    rows = whitened_rows(whitening.whiten(spark.createDataFrame(list(enumerate(cube)), "piece_id long, profile array<double>")))
    values = np.array([[rows[i][c]["whitened"] for c in (1, 2, 3)] for i in range(8)])
    assert np.abs(values.T @ values / 8 - np.eye(3)).max() < 1e-12


def test_offsets_beyond_64_bits_are_exact():
    centre = whitening.Centre(1 << 30, (5 << 40, -(3 << 50)))
    levels = np.array([[1 << 45, 7], [2, 3]])
    want = [[int(v) * (1 << 30) - s for v, s in zip(row, centre.sums, strict=True)] for row in levels]
    assert centre.offsets(levels).tolist() == want and centre.deviations(levels)[0] is None
    assert whitening.Centre(3, (6, 9)).deviations(np.array([[3, 1]])) == [9 + 36]


def test_bidiagonal_finds_all_values():
    rng = np.random.default_rng(5)
    for x in (rng.standard_normal((30, 6)), np.ones((4, 3)), np.zeros((3, 2)), np.diag([3.0, 3.0, 1.0])):
        values, vectors = whitening.bidiagonal(lambda z, x=x: x.T @ (x @ z), x.shape[1])
        assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[: x.shape[1]], atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(x.shape[1]), atol=1e-12)


def messy_rows(spark):
    rows = [(1, "Gloria in excelsis", "la"), (1, "Gloria in excelsis", "la"), (2, None, None), (3, "", "la"),
            (None, "sine nomine", "la"), (4, "Kyrie eleison. " * 30000, "la"), (5, " \t\n", None)]
    return spark.createDataFrame(rows, "piece_id long, content string, language string")


def test_messy_tables(spark, library):
    scores = messy_rows(spark)
    for name in ("key", "n", "size", "salt", "rank", "place", "pointers", "text_key", "token_ids", "phrase"):
        scores = scores.withColumn(name, F.lit("x"))
    coded = sentence_pieces.round_trip(scores, MODEL).collect()
    assert len(coded) == 7 and [r["n_tokens"] for r in coded if r["piece_id"] == 2] == [0]
    found = collocations.collocations(scores, min_count=2, max_words=2).collect()
    want = {("la", "kyrie eleison", 30000), ("la", "gloria in", 2), ("la", "in excelsis", 2)}
    assert {(r["language"], r["phrase"], r["n_phrase"]) for r in found} == want
    empty = scores.filter("false")
    assert sentence_pieces.round_trip(empty, MODEL).count() == 0
    assert collocations.collocations(empty).count() == 0


def test_messy_profiles(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, [1.0]), (None, [4.0, 9.0]), (8, [0.0, 0.0]), (9, [1e300, 0.0])]
    table = spark.createDataFrame(rows, "piece_id long, profile array<double>").withColumn("levels", F.lit(1)).withColumn("n", F.lit(2))
    found = whitening.whiten(table).collect()
    assert sorted({(r["piece_id"] is None, r["piece_id"] or 0) for r in found}) == [(False, 1), (False, 8), (True, 0)]
    assert len(found) == 4 * 2 and {r["n"] for r in found} == {3}
    assert whitening.whiten(table.filter("false")).count() == 0
    assert whitening.whiten(table.filter("piece_id = 1")).count() == 0
