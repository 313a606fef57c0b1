"""SentencePiece encoding and decoding of score documents with a public model, in vectorised merge rounds."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteloom.llm.columns import plain, text_of
from noteloom.llm.shipping import map_arrow, ship

#: Bytes of words and ids that a worker remembers, and the longest word among them.
CACHE_BYTES = 128 << 20
CACHED_WORD = 64
#: Characters of text whose new words are merged together.
SLICE_CHARS = 1 << 22

SPACE = "▁"
_NONE = np.iinfo(np.int32).max
# Kinds of vocabulary entries in a model file (fixed values of its format).
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """Entries of a model file: text, score and kind by id."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        entries = [dict(_fields(value)) for field, value in parts if field == 1]
        training = {key: value for field, part in parts if field == 2 for key, value in _fields(part)}
        normal = {key: value for field, part in parts if field == 3 for key, value in _fields(part)}
        kinds = [entry.get(3, _NORMAL) for entry in entries]
        if training.get(3, 1) != 2 or not training.get(35) or training.get(24):
            raise ValueError("only models of byte pairs with byte fallback and spaces in front are read")
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models that leave the text as it is and mark its start are read")
        if set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("models with pieces of the user or unused ones are not read")
        scores = [struct.unpack("<f", entry.get(2, bytes(4)))[0] for entry in entries]
        return cls([entry[1].decode() for entry in entries], scores, kinds)


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("noteloom-one-byte", _one_byte)


class PieceEncoder:
    """Encoder of a model of byte pairs.

    A text is cut before each run of spaces, which no piece of the model crosses; the
    model is asked for that when it is read. The new words of many texts lie in one flat array of
    symbols. In a round every word finds the best rank among its neighbouring pairs, all its
    leftmost pairs of that rank merge at once, and the arrays are compacted; words without
    a pair leave. Merging at once equals merging one after another unless a merge makes a pair of an
    equal or better rank; words where that happens are finished by a queue, pair by pair.
    """

    def __init__(self, path: str):
        model = Model.read(path)
        self.pieces, self.kinds = model.pieces, model.kinds
        plain_ids = [i for i, kind in enumerate(model.kinds) if kind == _NORMAL]
        if any(re.search(f"[^{SPACE}]{SPACE}", model.pieces[i]) for i in plain_ids):
            raise ValueError("a piece of the model has a space inside")
        ids = {model.pieces[i]: i for i in plain_ids}
        # Characters of pieces that are no pieces themselves get numbers behind the vocabulary.
        letters = sorted({letter for piece in ids for letter in piece} - ids.keys())
        symbols = ids | {letter: len(model.pieces) + i for i, letter in enumerate(letters)}
        self.n_ids = len(model.pieces)
        rank = {score: i for i, score in enumerate(sorted({model.scores[i] for i in plain_ids}, reverse=True))}
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[model.scores[i]], i)
        self.pairs = pairs
        keys = sorted(pairs)
        self._keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self._ranks = np.array([*(pairs[key][0] for key in keys), _NONE], np.int32)
        self._merged = np.array([*(pairs[key][1] for key in keys), -1], np.int64)
        # Every character has a number: its symbol, or one behind all symbols for those no piece knows.
        self._unknown = self.n_ids + len(letters)
        self._numbers = np.arange(0x110000, dtype=np.int64) + self._unknown
        for letter, i in symbols.items():
            if len(letter) == 1:
                self._numbers[ord(letter)] = i
        self._letters = letters
        self._bytes = {int(self.pieces[i][3:5], 16): i for i, kind in enumerate(model.kinds) if kind == _BYTE}
        self._words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._shown = [
            "" if kind == _CONTROL else " ⁇ " if kind == _UNKNOWN else piece.replace(SPACE, " ")
            for piece, kind in zip(model.pieces, model.kinds, strict=True)
        ]
        self._is_byte = np.array([kind == _BYTE for kind in model.kinds])
        self._byte_of = {i: byte for byte, i in self._bytes.items()}
        self._known: dict[str, bytes] = {}
        self._held = 0

    def words(self, text: str) -> list[str]:
        return self._words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and what it merges to; the last rank of all for pairs that do not merge."""
        key = left << 32 | right
        at = np.searchsorted(self._keys, key)
        at[self._keys[at] != key] = len(self._keys) - 1
        return self._ranks[at], self._merged[at]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        found = [b""] * len(words)
        if not words:
            return found
        symbols = self._numbers[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        names = np.arange(len(words))
        word = np.repeat(names, np.fromiter(map(len, words), np.int64, len(words)))
        rank, merged = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int64)
        self._look_up(np.arange(len(symbols)), symbols, word, rank, merged)
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            chosen = self._leftmost(np.flatnonzero(rank == best[word]))
            queued = np.zeros(len(names), bool)
            queued[word[self._out_of_turn(chosen, symbols, word, best, merged)]] = True
            leaving = queued | (best == _NONE)
            if leaving.any():
                gone = np.flatnonzero(leaving)
                rest = symbols[leaving[word]]
                ends = np.cumsum(np.diff(starts, append=len(symbols))[gone])
                data = rest.astype("<u4").tobytes()
                special = queued[gone]
                special[np.searchsorted(ends, np.flatnonzero(rest >= self.n_ids), "right")] = True
                start = 0
                for name, end, other, late in zip(
                    names[gone].tolist(), ends.tolist(), special.tolist(), queued[gone].tolist(), strict=True
                ):
                    if other:
                        part = rest[start:end]
                        found[name] = self._packed(self._in_order(part.tolist()) if late else part)
                    else:
                        found[name] = data[4 * start : 4 * end]
                    start = end
                stay = ~leaving[word]
                number = np.cumsum(~leaving) - 1
                symbols, rank, merged, word = symbols[stay], rank[stay], merged[stay], number[word[stay]]
                names = names[~leaving]
                continue
            symbols[chosen] = merged[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, rank, merged, word = symbols[keep], rank[keep], merged[keep], word[keep]
            at = np.cumsum(keep)[chosen] - 1
            self._look_up(np.concatenate([at, at[at > 0] - 1]), symbols, word, rank, merged)
        return found

    def _look_up(self, at: np.ndarray, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        """Rank of the pair that begins at each of the given places, and what it merges to."""
        rank[at] = _NONE
        at = at[at + 1 < len(symbols)]
        at = at[word[at] == word[at + 1]]
        rank[at], merged[at] = self._pair(symbols[at], symbols[at + 1])

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        found = np.searchsorted(self._keys, key)
        found[self._keys[found] != key] = len(self._keys) - 1
        return self._ranks[found], self._merged[found]

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of places in a row, whose pairs overlap, every second one from the left."""
        turn = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, turn, 0))
        return at[(turn - first) % 2 == 0]

    def _out_of_turn(
        self, chosen: np.ndarray, symbols: np.ndarray, word: np.ndarray, best: np.ndarray, merged: np.ndarray
    ) -> np.ndarray:
        """Chosen places whose merge makes a pair that would come before a later chosen place of the word."""
        more = np.append(word[chosen[1:]] == word[chosen[:-1]], False) if len(chosen) else np.zeros(0, bool)
        more &= best[word[chosen]] != _NONE
        at = chosen[more]
        if not len(at):
            return at
        new, limit = merged[at], best[word[at]]
        # A later place of the word exists, so the symbol behind the pair is of the word too.
        early = self._pair(new, symbols[at + 2])[0] <= limit
        inner = np.flatnonzero((at > 0) & (word[at - 1] == word[at]))
        before = at[inner]
        is_chosen = np.zeros(len(symbols), bool)
        is_chosen[chosen] = True
        merged_before = (before > 1) & is_chosen[before - 2]
        left = np.where(merged_before, merged[before - 2], symbols[before - 1])
        early[inner] |= self._pair(left, new[inner])[0] <= limit[inner]
        return at[early]

    def _in_order(self, symbols: list[int]) -> np.ndarray:
        """The rest of one word merged pair by pair, best rank first, then the leftmost."""
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def add(left: int, right: int) -> None:
            found = self.pairs.get(symbols[left] << 32 | symbols[right])
            if found:
                heapq.heappush(queue, (found[0], left, symbols[left], symbols[right]))

        for left in range(len(symbols) - 1):
            add(left, left + 1)
        while queue:
            _, left, first, second = heapq.heappop(queue)
            right = after[left]
            if right < 0 or symbols[left] != first or symbols[right] != second:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = self.pairs[first << 32 | second][1], -1
            far = after[left] = after[right]
            if far >= 0:
                before[far] = left
                add(left, far)
            if before[left] >= 0:
                add(before[left], left)
        return np.array([symbol for symbol in symbols if symbol >= 0], np.int64)

    def _packed(self, symbols: np.ndarray) -> bytes:
        if symbols.max() >= self.n_ids:  # letters without an id are written by their bytes
            out: list[int] = []
            for symbol in symbols.tolist():
                letter = self._letter(symbol)
                out += [self._bytes[byte] for byte in letter.encode()] if letter else [symbol]
            symbols = np.array(out)
        return symbols.astype("<u4").tobytes()

    def _letter(self, symbol: int) -> str:
        if symbol < self.n_ids:
            return ""
        return self._letters[symbol - self.n_ids] if symbol < self._unknown else chr(symbol - self._unknown)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers; the texts' new words are merged together."""
        cut = [self.words(text) for text in texts]
        known = self._known
        new = list(set().union(*cut) - known.keys())
        known.update(zip(new, self.merge_words(new), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > CACHED_WORD:
                del known[word]
            else:
                self._held += 4 * len(word) + len(known[word]) + 200
        if self._held > CACHE_BYTES:
            self._known, self._held = {}, 0
        return out

    def decode(self, ids: bytes) -> str:
        """The pieces of the ids in a row; pieces of bytes are read as UTF-8, and the space of the start goes."""
        numbers = np.frombuffer(ids, "<u4")
        rows = numbers.tolist()
        held = self._is_byte[numbers]
        if not held.any():
            shown = [self._shown[i] for i in rows]
        else:
            shown, at = [], 0
            for end in [*np.flatnonzero(np.diff(held)) + 1, len(rows)]:
                part, at = rows[at:end], end
                if self.kinds[part[0]] == _BYTE:
                    data = bytes(self._byte_of[i] for i in part)
                    shown.append(data.decode("utf-8", "noteloom-one-byte"))
                else:
                    shown += [self._shown[i] for i in part]
        first = next((i for i, number in enumerate(rows) if self.kinds[number] != _CONTROL), None)
        if first is not None and self.pieces[rows[first]].startswith(SPACE):
            return "".join(shown)[1:]
        return "".join(shown)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """The encoder of a file, read once in each Python worker."""
    return PieceEncoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and whole texts of a batch (piece_id, content), a few million characters at a time."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    turn = (np.cumsum(sizes) - sizes) // SLICE_CHARS
    edges = np.flatnonzero(np.diff(turn, prepend=-1))
    for start, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
        part = batch.slice(start, end - start)
        yield part.column(0), part.column(1).to_pylist()


def encode_pieces(scores: DataFrame, model: str) -> DataFrame:
    """Encode the whole content of every score document (piece_id, content).

    ``model`` is the path of the model file on every executor. Returns ``piece_id``
    and ``token_ids``, four little-endian bytes an id, without ids for begin and end. Null or empty content
    gives no ids. Rows are independent, so repeated ids are repeated rows and an empty table gives
    none. A text may be of any length; a word without spaces of n characters takes as many rounds as it has ranks to merge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model)
        for batch in batches:
            for names, texts in _slices(batch):
                yield pa.RecordBatch.from_arrays([names, pa.array(codec.encode(texts), pa.binary())], ["piece_id", "token_ids"])

    work = plain(scores, "piece_id", "content").select("piece_id", text_of().alias("content"))
    return map_arrow(work, run, StructType([work.schema["piece_id"]]).add("token_ids", "binary"))


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``piece_id`` and ``content`` of encoded documents (piece_id, token_ids).

    Null ids give an empty text. Ids of begin and end give nothing, bytes that are no
    UTF-8 give one replacement character each, and an id outside the model is an error.
    """

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(encoder(model).decode)

    ship(encoded.sparkSession)
    ids = F.coalesce(F.col("token_ids"), F.lit(b""))
    return plain(encoded, "piece_id", "token_ids").select("piece_id", text(ids).alias("content"))


def round_trip(scores: DataFrame, model: str) -> DataFrame:
    """Digests of encoding and decoding: ``piece_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Encodes and decodes each document of ``scores`` (piece_id, content) in one pass and keeps neither. ``ids_sha256``
    is over the decimal ids, joined by commas. Nulls, repeats and empty tables are as in ``encode_pieces``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model)
        decimal = [str(i) for i in range(codec.n_ids)]
        for batch in batches:
            for names, texts in _slices(batch):
                counts, ids_sums, text_sums = [], [], []
                for ids in codec.encode(texts):
                    numbers = np.frombuffer(ids, "<u4").tolist()
                    counts.append(len(numbers))
                    listed = ",".join(map(decimal.__getitem__, numbers))
                    ids_sums.append(hashlib.sha256(listed.encode()).hexdigest())
                    text_sums.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(counts, pa.int64()), pa.array(ids_sums), pa.array(text_sums)],
                    ["piece_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    work = plain(scores, "piece_id", "content").select("piece_id", text_of().alias("content"))
    schema = StructType([work.schema["piece_id"]]).add("n_tokens", "long")
    return map_arrow(work, run, schema.add("ids_sha256", "string").add("decoded_sha256", "string"))
