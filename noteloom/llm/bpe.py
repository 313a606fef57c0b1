"""Byte-pair encoding and decoding of score documents with a public vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Regex, normalizers, pre_tokenizers

from noteloom.llm.columns import plain, text_of
from noteloom.llm.shipping import map_arrow, ship

WORD_CACHE = 1 << 19
#: Longer words are encoded each time, so that the cache is bounded in bytes.
CACHED_LETTERS = 64

# Unicode white space, which the vocabulary's patterns know as \s.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


def latin_words() -> re.Pattern:
    """The word pattern for texts below U+0100, where the plain module can list the classes."""
    of = {kind: "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
    letters, digits = re.escape(of["L"]), re.escape(of["N"])
    return re.compile(rf"{_ENDINGS}|[{letters}]+|[{digits}]|[^\t-\r \x85\xa0{letters}{digits}]+")


@lru_cache(1)
def newer_points() -> re.Pattern:
    """Code points that the pattern module knows and ``unicodedata`` does not yet, as one class."""
    unassigned = "".join(chr(c) if unicodedata.category(chr(c)) == "Cn" else " " for c in range(0x110000))
    newer = [run.group() for run in regex.finditer(r"[^\p{Cn} ]+", unassigned)]
    return re.compile("[" + "".join(f"{run[0]}-{run[-1]}" for run in newer) + "]" if newer else "(?!)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    letters, extra = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in shown else extra))
        extra += byte not in shown
    return letters


class WordEncoder:
    """Encoder of a vocabulary file whose words end in a suffix.

    A text is cut at special tokens, composed (NFC), lowered and cut into words. A
    word is a doubly linked list of symbols: a queue holds each neighbouring pair
    that may merge by rank and place, the best is merged, its new neighbours are
    queued, and entries whose symbols have changed since are skipped.
    """

    def __init__(self, path: str, cache: int = WORD_CACHE):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocabulary.items(), *self.special.items()]}
        # A pair of ids is one number, so that a lookup builds no tuple.
        self.ranks: dict[int, int] = {}
        self.pairs: list[int] = []
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            pair = self.vocabulary[left] << 20 | self.vocabulary[right]
            self.ranks.setdefault(pair, rank)
            self.pairs.append(pair)
            self.merged.append(self.vocabulary[left + right])
        letters = byte_letters()
        self._inner = [self.vocabulary.get(letter, -1) for letter in letters]
        self._last = [self.vocabulary.get(letter + self.suffix, -1) for letter in letters]
        self._cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._words = regex.compile(rf"{_ENDINGS}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self._latin_words = latin_words()
        # Whether points newer than Python's tables are letters, only the vocabulary's own library can say.
        self._newer = newer_points()
        self._lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        own = Regex(rf"{_ENDINGS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+")
        self._split = pre_tokenizers.Split(own, "removed", invert=True)
        self._cached = lru_cache(cache)(self._packed)

    def words(self, text: str) -> list[str]:
        # Lowering is by character: a capital sigma never becomes a final one.
        lower = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        lower = lower.lower()
        try:
            lower.encode("latin-1")
        except UnicodeEncodeError:
            if self._newer.search(text):
                return [word for word, _ in self._split.pre_tokenize_str(self._lower.normalize_str(text))]
            return self._words.findall(lower)
        return self._latin_words.findall(lower)

    def word_ids(self, word: str) -> list[int]:
        data = word.encode()
        ids = [self._inner[byte] for byte in data]
        ids[-1] = self._last[data[-1]]
        if -1 in ids:  # letters that the vocabulary lacks go
            ids = [i for i in ids if i >= 0]
        count = len(ids)
        after = [*range(1, count), -1]
        before = [*range(-1, count - 1)]
        ranks, pairs = self.ranks, self.pairs
        # A queue entry is rank * count + place: best rank first, then the leftmost place.
        queue = [
            rank * count + left
            for left, pair in enumerate(zip(ids, ids[1:], strict=False))
            if (rank := ranks.get(pair[0] << 20 | pair[1])) is not None
        ]
        heapq.heapify(queue)
        while queue:
            rank, left = divmod(heapq.heappop(queue), count)
            right = after[left]
            if right < 0 or ids[left] << 20 | ids[right] != pairs[rank] or ids[left] < 0:
                continue  # stale: one of the two has been merged since
            ids[left], ids[right] = self.merged[rank], -1
            far = after[left] = after[right]
            if far >= 0:
                before[far] = left
                if (rank := ranks.get(ids[left] << 20 | ids[far])) is not None:
                    heapq.heappush(queue, rank * count + left)
            near = before[left]
            if near >= 0 and (rank := ranks.get(ids[near] << 20 | ids[left])) is not None:
                heapq.heappush(queue, rank * count + near)
        return [i for i in ids if i >= 0]

    def packed(self, words: list[str]) -> list[bytes]:
        return [self._cached(word) if len(word) <= CACHED_LETTERS else self._packed(word) for word in words]

    def _packed(self, word: str) -> bytes:
        return struct.pack(f"<{len(ids := self.word_ids(word))}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text, each as four little-endian bytes."""
        if not self._cut or "<" not in text:
            return b"".join(self.packed(self.words(text)))
        out, start = [], 0
        for found in self._cut.finditer(text):
            out += self.packed(self.words(text[start : found.start()]))
            out.append(self.special[found.group()].to_bytes(4, "little"))
            start = found.end()
        out += self.packed(self.words(text[start:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings of the ids, separated by spaces, special tokens too."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """The encoder of a file, read once in each Python worker."""
    return WordEncoder(path)


def encode_pieces(scores: DataFrame, vocabulary: str) -> DataFrame:
    """Encode the whole content of every score document (piece_id, content).

    ``vocabulary`` is the path of the vocabulary file on every executor. Returns
    ``piece_id`` and ``token_ids``, four little-endian bytes an id; null content
    is empty and gives no ids. Rows are independent, so repeated ids are repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        for batch in batches:
            ids = [codec.encode(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["piece_id", "token_ids"])

    work = plain(scores, "piece_id", "content").select("piece_id", text_of().alias("content"))
    return map_arrow(work, run, StructType([work.schema["piece_id"]]).add("token_ids", "binary"))


def decode_pieces(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``piece_id`` and ``content`` of encoded documents (piece_id, token_ids); null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(encoder(vocabulary).decode)

    ship(encoded.sparkSession)
    ids = F.coalesce(F.col("token_ids"), F.lit(b""))
    return plain(encoded, "piece_id", "token_ids").select("piece_id", text(ids).alias("content"))


def round_trip(scores: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of encoding and decoding: ``piece_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Encodes and decodes each document of ``scores`` (piece_id, content) in one pass and keeps neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        for batch in batches:
            counts, ids_sums, text_sums = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sums), pa.array(text_sums)],
                ["piece_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    work = plain(scores, "piece_id", "content").select("piece_id", text_of().alias("content"))
    schema = StructType([work.schema["piece_id"]]).add("n_tokens", "long")
    return map_arrow(work, run, schema.add("ids_sha256", "string").add("decoded_sha256", "string"))
