"""Packing tokenised score documents into sequences by non-negative least squares."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteloom.llm.columns import plain, stored, text_of
from noteloom.llm.shipping import map_arrow

WINDOW = 2048
STEP = 16
DEPTH = 3
STRIPES = 64
BATCH_PIECES = 1 << 14
#: The vocabulary's words: contractions, letters, digits, other signs with one space before, and spaces.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPECIAL = "<|endoftext|>"


class Tokens:
    """Ids of a byte-level vocabulary; its special token in a text is one id."""

    def __init__(self, ranks_path: str, special_id: int):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.special_id = special_id
        self._encode = tiktoken.Encoding(
            "vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def ids(self, text: str) -> list[int]:
        first, *rest = text.split(SPECIAL)
        out = self._encode(first)
        for part in rest:
            out.append(self.special_id)
            out += self._encode(part)
        return out


@lru_cache(2)
def tokens(ranks_path: str, special_id: int) -> Tokens:
    return Tokens(ranks_path, special_id)


def cut(scores: DataFrame, ranks_path: str, special_id: int, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of at most ``window`` ids of each score document (piece_id, content).

    A document is its ids and ``end_id``; it is cut every ``window`` ids, so only
    its last piece is shorter. Null content is empty and leaves the end id alone.
    Returns ``piece_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens(ranks_path, special_id)
        names = ["piece_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            at: list[int] = []
            rows: list[tuple[int, int, int, int]] = []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*vocabulary.ids(text.as_py()), end_id], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    at.append(row)
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    work = plain(scores, "piece_id", "content").select("piece_id", text_of().alias("content"))
    schema = StructType([work.schema["piece_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    return map_arrow(work, run, schema)


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of at most ``depth`` bin sizes that fill ``bins`` exactly."""

    def grow(room: int, largest: int, left: int) -> Iterator[tuple[int, ...]]:
        if room == 0:
            yield ()
        elif left:
            for size in range(min(room, largest), (room - 1) // left, -1):
                for rest in grow(room - size, size, left - 1):
                    yield (size, *rest)

    return list(grow(bins, bins, depth))


def non_negative_least_squares(matrix: np.ndarray, wanted: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that makes ``matrix @ x`` close to ``wanted``, by accelerated projected gradients."""
    gram, aim = matrix.T @ matrix, matrix.T @ wanted
    rate = 1.0 / max(np.linalg.norm(matrix, 2) ** 2, 1e-12)
    x = ahead = np.zeros(matrix.shape[1])
    pace = 1.0
    for _ in range(rounds):
        step = np.maximum(ahead - rate * (gram @ ahead - aim), 0.0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = step + (pace - 1) / faster * (step - x)
        x, pace = step, faster
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH, step: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination of lengths, so that every piece has a place.

    ``histogram[n]`` counts the pieces of length n+1 out of ``len(histogram)``, the
    window. For least squares lengths are rounded up to bins of ``step``: combinations of at most
    ``depth`` bins that fill the window get their repeat counts against the bins; they are rounded
    and cut back to the pieces there are, and take the longest of a bin first. What is left is packed greedily by
    true lengths, the longest first and then the longest that fit; equal fillings are taken at once, so
    the work depends on the number of lengths, never of pieces.
    """
    window = len(histogram)
    bins = window // step
    left = histogram.astype(np.int64).copy()
    used: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        rough = left.reshape(bins, step).sum(1)
        shapes = combinations(bins, depth)
        matrix = np.zeros((bins, len(shapes)))
        for column, shape in enumerate(shapes):
            for size in shape:
                matrix[size - 1, column] += 1
        scale = max(rough.max(), 1)
        counts = np.rint(non_negative_least_squares(matrix, rough / scale) * scale).astype(np.int64)
        for column in np.argsort(-counts, kind="stable"):
            need = matrix[:, column].astype(np.int64)
            times = int(min(counts[column], (rough[need > 0] // need[need > 0]).min()))
            if times > 0:
                used += _longest(shapes[column], times, left, step)
                rough -= need * times
    sizes = [int(size) for size in np.flatnonzero(left) + 1]
    while sizes:
        room, need = window, {}
        at = len(sizes)
        while at and (at := bisect_right(sizes, room, 0, at)):
            at -= 1
            need[sizes[at]] = take = min(room // sizes[at], int(left[sizes[at] - 1]))
            room -= sizes[at] * take
        times = min(int(left[size - 1]) // many for size, many in need.items())
        used.append((tuple(size for size, many in need.items() for _ in range(many)), times))
        for size, many in need.items():
            left[size - 1] -= many * times
        sizes = [size for size in sizes if left[size - 1]]
    return used


def _longest(shape: tuple[int, ...], times: int, left: np.ndarray, step: int) -> list[tuple[tuple[int, ...], int]]:
    """The longest pieces of the shape's bins, ``times`` of each, taken out of ``left``."""
    out = []
    while times:
        lengths, need = [], Counter()
        for size in shape:
            span = range(size * step, (size - 1) * step, -1)
            length = next(n for n in span if left[n - 1] > need[n])
            lengths.append(length)
            need[length] += 1
        many = min(times, *(int(left[n - 1]) // k for n, k in need.items()))
        out.append((tuple(lengths), many))
        for n, k in need.items():
            left[n - 1] -= k * many
        times -= many
    return out


def places(used: list[tuple[tuple[int, ...], int]], first_sequence: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges of a length's pieces and where they go: length, from, to, pieces a sequence, first sequence, shape."""
    taken: dict[int, int] = {}
    rows, sequence = [], first_sequence
    for number, (shape, times) in enumerate(used):
        for size in sorted(set(shape), reverse=True):
            many = shape.count(size)
            start = taken.get(size, 0)
            taken[size] = start + many * times
            rows.append((size, start, taken[size], many, sequence, number))
        sequence += times
    return rows


def pack(
    scores: DataFrame,
    ranks_path: str,
    special_id: int,
    end_id: int,
    window: int = WINDOW,
    step: int = STEP,
    depth: int = DEPTH,
    stripes: int = STRIPES,
) -> DataFrame:
    """Pack all score documents (piece_id, content) into sequences of ``window`` ids.

    Full pieces are sequences of their own. The others are counted by length, and
    ``plan`` says which lengths share a sequence; ``step`` is the width of its bins for least squares.
    Returns a row per piece: ``piece_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset``. Empty documents hold their end id; repeated
    rows are packed each.

    Only the histogram (``window`` counts per stripe at most) and the plan leave
    Spark. Pieces are numbered inside ``stripes`` stripes of a length, so a length that
    holds most of them is not one task.
    """
    if window % step or window < step or step < 1:
        raise ValueError(f"step must divide the window, not {step} and {window}")
    spark = scores.sparkSession
    pieces = stored(
        cut(scores, ranks_path, special_id, end_id, window)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumns({
            "bin": F.col("length").cast("int"),
            "stripe": F.pmod(F.xxhash64("row", "ids_crc32"), F.lit(stripes)).cast("int"),
        }),
        "pieces",
    )
    sizes = pieces.groupBy("bin", "stripe").agg(F.count("*").alias("n")).collect()
    starts, totals = [], np.zeros(window + 1, np.int64)
    for row in sorted(sizes, key=lambda r: (r["bin"], r["stripe"])):
        starts.append((row["bin"], row["stripe"], int(totals[row["bin"]])))
        totals[row["bin"]] += row["n"]
    full, totals[window] = int(totals[window]), 0
    ranges = [(window, 0, full, 1, 0, -1), *places(plan(totals[1:], depth, step), full)]
    starts_table = spark.createDataFrame(starts, "bin int, stripe int, earlier long")
    ranges_table = spark.createDataFrame(
        ranges, "bin int, lowest long, above long, many long, first_sequence long, shape int"
    )
    order = Window.partitionBy("bin", "stripe").orderBy("row", "start")
    ranked = (
        pieces.withColumn("place", F.row_number().over(order) - 1)
        .join(F.broadcast(starts_table), ["bin", "stripe"])
        .withColumn("rank", F.col("earlier") + F.col("place"))
    )
    # Both tables are bounded by the plan: stripes x lengths rows, and a few rows for each combination in use.
    meets = (F.col("r.bin") == F.col("p.bin")) & (F.col("rank") >= F.col("lowest")) & (F.col("rank") < F.col("above"))
    assigned = (
        ranked.alias("p")
        .join(F.broadcast(ranges_table.alias("r")), meets)
        .select(
            "piece_id", "start", "length", "ids_crc32", "doc_tokens", "row",
            F.expr("first_sequence + (rank - lowest) div many").alias("sequence_id"),
        )
    )
    # A sequence holds at most ``window`` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start")
    before = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return assigned.select(
        "piece_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(before, F.lit(0)).cast("long").alias("offset"),
    )
