"""Phrases that recur in the words of score documents, mined by Rabin-Karp fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteloom.llm.columns import forget, plain, stored, text_of
from noteloom.llm.shipping import map_arrow

#: The language of documents that name none.
UNKNOWN = "und"
#: Bits of the filter that keeps n-grams with a rare part from being counted (4 MB).
FILTER_BITS = 25
#: Bits of the second fingerprint that go with the first.
CHECK_BITS = 24
#: Hash values of texts that are compared before texts are sent to their pointers.
WANTED_BITS = 18
#: Words of documents hashed together.
SLICE_WORDS = 1 << 20
#: Words that a task numbers before it starts anew.
VOCABULARY = 1 << 17
#: Rows of an Arrow batch.
BATCH_ROWS = 1 << 16
SALTS = 64

_BREAK, _GAP = b"\xff", b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _GAP + b"\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * len(_GAP) + b" "
)
# Odd multipliers of the two polynomials.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def tokens(content: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lowered, with a break (0xff) for each character between two pieces."""
    return content.translate(_TABLE).replace(_BREAK, b" \xff ").split()


class _Words(dict):
    """Numbers of words, with two independent hashes of each; number 0 is the break."""

    def __init__(self):
        super().__init__({_BREAK: 0})
        self._digests = bytearray(16)

    def __missing__(self, word: bytes) -> int:
        self._digests += xxhash.xxh3_128_digest(word)
        self[word] = number = len(self)
        return number

    def hashes(self) -> np.ndarray:
        """A row of two hashes for each number."""
        return np.frombuffer(self._digests, ">u8").astype(np.uint64).reshape(-1, 2)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Grams:
    """The words of several documents in one array, with prefix polynomials of their hashes.

    The fingerprint of the n words from place i on is ``(H[i + n] - H[i]) / base ** i``
    modulo 2^64 with ``H`` the running sum of ``hash * base ** place``, plus a
    number of the language, so that languages do not meet. ``keys`` has the fingerprints
    by which occurrences are counted, ``checks`` the high bits of those of the other polynomial.
    """

    def __init__(self, numbers: np.ndarray, hashes: np.ndarray, salts: np.ndarray):
        self._salts = salts
        places = np.arange(len(numbers))
        ends = np.where(numbers == 0, places, len(numbers))
        self._room = np.minimum.accumulate(ends[::-1])[::-1] - places
        self._sums, self._back = [], []
        for side, base in enumerate(_BASES):
            terms = hashes[numbers, side] * _powers(base, len(numbers))
            self._sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))
            self._back.append(_powers(pow(base, -1, 1 << 64), len(numbers)))

    def fits(self, n: int) -> np.ndarray:
        """Whether n words of one piece follow each place; the empty n-gram stands at every word."""
        return self._room >= max(n, 1)

    def keys(self, n: int, bits: int) -> np.ndarray:
        return self._prints(0, n) & np.uint64((1 << bits) - 1)

    def checks(self, n: int) -> np.ndarray:
        return (self._prints(1, n) >> np.uint64(64 - CHECK_BITS)).astype(np.int32)

    def _prints(self, side: int, n: int) -> np.ndarray:
        """The fingerprint at each place; those near the end, where n words do not fit, mean nothing."""
        sums, out = self._sums[side], self._salts.copy()
        if n:
            last = max(len(sums) - n, 0)
            out[:last] += (sums[n:] - sums[:last]) * self._back[side][:last]
        return out


def _in_filter(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    spot = keys & np.uint64((1 << FILTER_BITS) - 1)
    return (found[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _filter_of(rows: DataFrame) -> Broadcast:
    """A bit for the low bits of each ``key``: at most 2^FILTER_BITS / 64 rows leave the executors, however many keys there are."""
    spot = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    words = rows.select(F.shiftright(spot, 6).alias("word"), spot.bitwiseAND(63).cast("int").alias("bit"))
    packed = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    found = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found[packed["word"].to_numpy()] = packed["bits"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(found.view(np.uint8))


def _salt(language: str) -> int:
    return xxhash.xxh3_64_intdigest(language.encode())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The documents (text_key, language, content) in slices of about ``SLICE_WORDS`` words.

    Gives their n-grams, word numbers, each word's document, the documents' first places, text keys and languages, and the words.
    """
    vocabulary = _Words()
    parts: list[np.ndarray] = []
    keys: list[int] = []
    languages: list[str] = []
    held = 0

    def cut():
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = np.concatenate(parts)
        document = np.repeat(np.arange(len(parts)), sizes)
        salts = np.array([_salt(language) for language in languages], np.uint64)
        grams = _Grams(numbers, vocabulary.hashes(), salts[document])
        return grams, numbers, document, np.cumsum(sizes) - sizes, np.array(keys, np.int64), languages, vocabulary

    for batch in batches:
        for key, language, content in zip(*map(batch.column, ("text_key", "language", "content")), strict=True):
            words = tokens(content.as_py())
            found = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
            parts.append(np.append(found, 0))
            keys.append(key.as_py())
            languages.append(language.as_py())
            held += len(words) + 1
            if held >= SLICE_WORDS:
                yield cut()
                parts, keys, languages, held = [], [], [], 0
                if len(vocabulary) > VOCABULARY:
                    vocabulary = _Words()
    if parts:
        yield cut()


_COUNTS = "size int, key long, check int, n int, pointer long"


def _counted(
    sizes: tuple[int, ...], bits: int, known: Broadcast | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fingerprints of the n-grams of the sizes, how often each occurs in the slice, and a place where it stands.

    A pointer is 32 bits of a text's key and the place in the text. With a filter of the frequent n-grams of one
    word less, only those are counted of which both parts may be frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, _, document, starts, texts, _, _ in _slices(batches):
            for n in sizes:
                counted = grams.fits(n)
                if known is not None:
                    frequent = _in_filter(grams.keys(n - 1, bits), known.value)
                    counted[:-1] &= frequent[:-1] & frequent[1:]
                at = np.flatnonzero(counted)
                key, check = grams.keys(n, bits)[at], grams.checks(n)[at]
                order = np.argsort(key)
                key, check, at = key[order], check[order], at[order]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))[: len(at)])
                owner = document[at[first]]
                columns = (
                    np.full(len(first), n, np.int32),
                    key[first].view(np.int64),
                    check[first],
                    np.diff(first, append=len(key)).astype(np.int32),
                    texts[owner] << 32 | at[first] - starts[owner],
                )
                for start in range(0, len(first), BATCH_ROWS):
                    part = [pa.array(column[start : start + BATCH_ROWS]) for column in columns]
                    yield pa.RecordBatch.from_arrays(part, ["size", "key", "check", "n", "pointer"])

    return run


def _by_words(n: int, bits: int, wanted: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """N-grams of the wanted fingerprints by their words, and how often each occurs in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, numbers, document, _, _, languages, vocabulary in _slices(batches):
            key = grams.keys(n, bits)
            at = np.flatnonzero(grams.fits(n) & _in_filter(key, wanted.value))
            key = key[at]
            if not len(at):
                continue
            named = {name: i for i, name in enumerate(dict.fromkeys(languages))}
            language = np.array([named[name] for name in languages])[document[at]]
            columns = np.stack([language, key.view(np.int64), *[numbers[at + i] for i in range(n)]], 1)
            found, count = np.unique(columns, axis=0, return_counts=True)
            spelled, names = list(vocabulary), list(named)
            phrases = [b" ".join(spelled[i] for i in row).decode() for row in found[:, 2:].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 1]), pa.array([names[i] for i in found[:, 0]]), pa.array(phrases), pa.array(count)],
                ["key", "language", "phrase", "n"],
            )

    return run


def _prints_of(language: str, words: list[bytes]) -> tuple[int, int]:
    """Both fingerprints of the words, as ``_Grams`` has them."""
    hashes = [divmod(xxhash.xxh3_128_intdigest(word), 1 << 64) for word in words]
    key, check = (
        _salt(language) + sum(h[side] * pow(base, i, 1 << 64) for i, h in enumerate(hashes)) for side, base in enumerate(_BASES)
    )
    return key % (1 << 64), (check % (1 << 64)) >> (64 - CHECK_BITS)


def _spelled(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words at the pointers of each text, where they have the fingerprints that point there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for language, content, pointers in zip(*map(batch.column, ("language", "content", "pointers")), strict=True):
                name, words = language.as_py(), tokens(content.as_py())
                for found in pointers.as_py():
                    place = found["pointer"] & ((1 << 32) - 1)
                    part = words[place : place + found["size"]]
                    key, check = _prints_of(name, part)
                    same = (key - found["key"]) % (1 << bits) == 0 and check == found["check"]
                    if same and len(part) == found["size"]:
                        for column, cell in zip(out, (name, len(part), b" ".join(part).decode(), found["n"]), strict=True):
                            column.append(cell)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            columns = [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["language", "size", "phrase", "n"])

    return run


def phrase_counts(scores: DataFrame, min_count: int = 100, max_words: int = 5, fingerprint_bits: int = 64) -> DataFrame:
    """Phrases of up to ``max_words`` words that occur at least ``min_count`` times in one language.

    ``scores`` has ``piece_id``, ``content`` and ``language``. Returns ``language``, ``size`` (words), ``phrase`` and ``n``
    (occurrences, overlapping ones too); the empty phrase has one row a language, with the number of all words, however few.

    One pass for each size counts fingerprints of 64 bits. An n-gram is counted only if both its parts of one word
    less may be frequent (a filter of ``2^FILTER_BITS`` bits that never says no to a frequent one), and a task
    sums its own before they are shuffled. With each fingerprint goes a pointer, a text and a place, and the
    range of 24 bits of a second one. Where that range shows several phrases under one fingerprint, they are
    counted again by their words; the others are spelled out at their pointer, from few texts.
    ``fingerprint_bits`` under 64 makes such meetings frequent and changes no result.
    """
    if min_count < 1 or max_words < 1 or not 1 <= fingerprint_bits <= 64:
        raise ValueError(f"min_count, max_words and fingerprint_bits are out of range: {min_count}, {max_words}, {fingerprint_bits}")
    text = text_of()
    named = plain(scores, "content", "language").select(
        F.coalesce(F.col("language").cast("string"), F.lit(UNKNOWN)).alias("language"), text.alias("content")
    )
    low_half = F.xxhash64("language", "content").bitwiseAND((1 << 32) - 1)
    keyed = named.select(low_half.alias("text_key"), "language", F.encode("content", "utf-8").alias("content"))
    frequent, recounted, known = [], [], None
    for sizes in ((0, 1), *((size,) for size in range(2, max_words + 1))):
        rows = map_arrow(keyed, _counted(sizes, fingerprint_bits, known), _COUNTS)
        level = rows.groupBy("size", "key").agg(
            F.max("pointer").alias("pointer"),
            F.min("check").alias("check"),
            F.max("check").alias("last_check"),
            F.sum("n").alias("n"),
        )
        level = stored(level.filter((F.col("n") >= min_count) | (F.col("size") == 0)), f"phrases-of-{sizes[-1]}")
        for size in sizes:
            met = level.filter((F.col("size") == size) & (F.col("check") < F.col("last_check"))).select("key")
            if not met.isEmpty():
                wanted = _filter_of(met)
                again = map_arrow(
                    keyed, _by_words(size, fingerprint_bits, wanted), "key long, language string, phrase string, n long"
                )
                again = again.join(met, "key", "left_semi").groupBy("language", "phrase").agg(F.sum("n").alias("n"))
                again = again.select("language", F.lit(size).alias("size"), "phrase", "n")
                recounted.append(stored(again.filter(F.col("n") >= (min_count if size else 1)), "recounted"))
                wanted.unpersist()
        frequent.append(level)
        if known is not None:
            known.unpersist()
        known = _filter_of(level.filter(F.col("size") == sizes[-1]))
    known.unpersist()

    text_of_pointer = F.shiftrightunsigned("pointer", 32).alias("text_key")
    pointers = reduce(DataFrame.union, frequent).filter("check = last_check")
    pointers = stored(
        pointers.groupBy(text_of_pointer)
        .agg(F.collect_list(F.struct("size", "key", "check", "pointer", "n")).alias("pointers")),
        "pointers",
    )
    # A text has at most as many pointers as n-grams. Their texts are told apart by some low bits first, so
    # that few others are shuffled: 2^WANTED_BITS rows at most are broadcast.
    low = F.col("text_key").bitwiseAND((1 << WANTED_BITS) - 1)
    texts = (
        keyed.withColumn("low", low)
        .join(F.broadcast(pointers.select(low.alias("low")).distinct()), "low", "left_semi")
        .groupBy("text_key", "language", F.xxhash64("content").alias("hi"), F.xxhash64(F.lit(1), "content").alias("lo"))
        .agg(F.first("content").alias("content"))
    )
    spelled = map_arrow(
        texts.join(pointers, "text_key").select("language", "content", "pointers"),
        _spelled(fingerprint_bits),
        "language string, size int, phrase string, n long",
    )
    counts = stored(
        reduce(DataFrame.union, [spelled.dropDuplicates(["language", "size", "phrase"]), *recounted]), "phrases"
    )
    forget(pointers, *frequent, *recounted)
    return counts


def _joined(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def collocations(
    scores: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, fingerprint_bits: int = 64
) -> DataFrame:
    """The phrases of each language whose words belong together most.

    ``scores`` has ``content`` and ``language``, as score documents have. A-Z is lowered; words end at spaces and
    tabs, and phrases also at line ends (feed, vertical tab, form feed, return) and ``. , ; : ! ?``.
    Candidates are phrases of 2 to ``max_words`` words with at least ``min_count`` occurrences. Cut after its
    first k words, a phrase has the score ``1000 * n_phrase * n_words // (n_first * n_rest)``; its lowest cut counts, the
    shortest first part of equal ones. Candidates that never occur but inside one longer candidate go. Returns
    ``language``, ``rank``, ``phrase``, ``n_phrase``, ``n_first``, ``n_rest``, ``n_words``, ``score``: the first ``top`` of each
    language by score, then by n_phrase, then by the bytes of the phrase.

    Null content is empty and a null language is ``und``; a row that repeats counts as often as it stands; an empty
    table, or one without phrases, gives no rows. All is exact, whatever the size of texts and counts below 10^12.
    """
    counts = phrase_counts(scores, min_count, max_words, fingerprint_bits)
    # Every language's number of words for each of SALTS salts, so that no language is one join key.
    total = counts.filter("size = 0").select(
        "language", F.col("n").alias("n_words"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    found = counts.filter("size > 1").select(
        "language", "phrase", "size", F.col("n").alias("n_phrase"), F.split("phrase", " ").alias("words")
    )
    inner = found.filter("size > 2").select(
        "language",
        F.explode(F.array(_joined(F.lit(1), F.col("size") - 1), _joined(F.lit(2), F.col("size") - 1))).alias("phrase"),
        "n_phrase",
    )
    inner = inner.groupBy("language", "phrase").agg(F.max("n_phrase").alias("n_longer"))
    own = found.join(inner, ["language", "phrase"], "left").filter("n_longer is null or n_longer < n_phrase").drop("n_longer")
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "language", "phrase", "n_phrase", "cut",
        _joined(F.lit(1), F.col("cut")).alias("first"), _joined(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"),
    )
    parts = counts.filter("size > 0").select("language", "phrase", "n")
    firsts = parts.toDF("language", "first", "n_first")
    rests = parts.toDF("language", "rest", "n_rest")
    salted = cuts.join(firsts, ["language", "first"]).join(rests, ["language", "rest"]).withColumn(
        "salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    )

    def big(name: str) -> Column:
        return F.col(name).cast("decimal(18,0)")

    scored = salted.join(total, ["language", "salt"]).withColumns(
        {"over": F.lit(1000).cast("decimal(4,0)") * big("n_phrase") * big("n_words"), "under": big("n_first") * big("n_rest")}
    )
    best = scored.groupBy("language", "salt", "phrase", "n_phrase", "n_words").agg(
        F.min(F.struct(F.expr("over div under").alias("score"), "cut", "n_first", "n_rest")).alias("best")
    )
    ranked = best.select("language", "salt", "phrase", "n_phrase", "n_words", "best.n_first", "best.n_rest", "best.score")
    # The first of each salt, then of groups of salts: no task ranks a whole language.
    for salts in (SALTS, 8, 1):
        order = Window.partitionBy("language", F.col("salt") % salts).orderBy(F.desc("score"), F.desc("n_phrase"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(
        "language", F.col("rank").cast("long").alias("rank"), "phrase", "n_phrase", "n_first", "n_rest", "n_words", "score"
    )
