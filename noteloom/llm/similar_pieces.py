"""Pieces with the nearest profiles, by multi-index hashing of learned binary codes."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.columns import plain, stored
from noteloom.llm.shipping import ship

CODE_BITS = 64
SUBSTRINGS = 4
SAMPLE = 16384
SHARD_ROWS = 16384
BLOCK_QUERIES = 1024
RECALL = 0.96


@dataclass(frozen=True)
class Codes:
    """A learned rotation to binary codes and the Hamming radius to search.

    Vectors are first lengthened by one component that brings them to one norm,
    so that the nearest by angle are the nearest by inner product.
    """

    norm: float
    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        return (lengthened(vectors, self.norm, query) - self.centre) @ self.rotation > 0


def lengthened(vectors: np.ndarray, norm: float, query: bool = False) -> np.ndarray:
    """Vectors of one norm: data get what they lack as a last component, queries none."""
    lengths = np.linalg.norm(vectors, axis=1)
    if query:
        return np.column_stack([vectors / lengths[:, None], np.zeros(len(vectors))])
    rest = np.sqrt(np.maximum(norm * norm - lengths * lengths, 0.0))
    return np.column_stack([vectors, rest]) / norm


def learn(sample: np.ndarray, norm: float, total: int, k: int, bits: int = CODE_BITS, recall: float = RECALL) -> Codes:
    """Principal axes of the sample, turned until signs lose least (iterative quantisation).

    The radius is the smallest that holds ``recall`` of the sample's nearest
    neighbours. Of ``total`` vectors the sample's share of ``k`` neighbours counts, one at least, so a
    sample is never closer than the whole.
    """
    data = lengthened(sample, norm)
    centre = data.mean(0)
    _, axes = np.linalg.eigh(np.cov((data - centre).T) if len(data) > 1 else np.eye(data.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    if axes.shape[1] < bits:  # fewer axes than bits: rows of a fixed random matrix fill the code
        more = np.random.default_rng(7).normal(size=(axes.shape[0], bits - axes.shape[1]))
        axes = np.column_stack([axes, more / np.linalg.norm(more, axis=0)])
    turned = (data - centre) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(bits, bits)))
    for _ in range(30):
        u, _, v = np.linalg.svd(np.where(turned @ turn > 0, 1.0, -1.0).T @ turned)
        turn = (u @ v).T
    codes = Codes(norm, centre, axes @ turn, bits)
    if len(sample) < 3:
        return codes
    asked = sample[np.random.default_rng(3).permutation(len(sample))[:256]]
    scores = asked @ sample.T
    near = max(1, min(len(sample) - 1, round(k * len(sample) / max(total, 1))))
    best = np.argpartition(-scores, near, axis=1)[:, : near + 1]  # the query itself is among them
    apart = (codes.of(asked, True)[:, None, :] != codes.of(sample)[best]).sum(2)
    own = np.argmax(np.take_along_axis(scores, best, 1), axis=1)
    others = np.ones(best.shape, bool)
    others[np.arange(len(best)), own] = False
    return Codes(norm, centre, codes.rotation, int(np.quantile(apart[others], recall, method="higher")))


def pack_bits(codes: np.ndarray) -> np.ndarray:
    padded = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 64)))
    return np.packbits(padded, axis=1).view(np.uint64)


class SubstringIndex:
    """Codes cut into substrings, each with a table from value to rows."""

    def __init__(self, codes: np.ndarray, substrings: int = SUBSTRINGS):
        self.codes = pack_bits(codes)
        self.width = codes.shape[1] // substrings
        self.parts = self._split(codes, substrings)
        self.rows, self.starts = [], []
        for part in self.parts.T:
            order = np.argsort(part, kind="stable")
            self.rows.append(order)
            self.starts.append(np.searchsorted(part[order], np.arange((1 << self.width) + 1)))

    def _split(self, codes: np.ndarray, substrings: int) -> np.ndarray:
        weights = 1 << np.arange(self.width)[::-1]
        return codes.reshape(len(codes), substrings, self.width) @ weights

    def masks(self, radius: int) -> list[np.ndarray]:
        """What to flip in each substring. A code within ``radius`` is within ``radius // m`` in
        one of the first ``radius % m + 1`` substrings, or one nearer in one of the others."""
        count = len(self.rows)
        step, over = divmod(radius, count)

        def flips(reach: int) -> np.ndarray:
            values = [sum(1 << bit for bit in bits) for n in range(reach + 1) for bits in combinations(range(self.width), n)]
            return np.array(values, np.int64)

        near, far = flips(min(step, self.width)), flips(min(step - 1, self.width)) if step else np.zeros(0, np.int64)
        return [near if place <= over else far for place in range(count)]

    def within(self, code: np.ndarray, radius: int, masks: list[np.ndarray]) -> np.ndarray:
        """Rows of every code within the radius of one code."""
        found = np.zeros(len(self.codes), bool)
        parts = self._split(code[None], len(self.rows))[0]
        for part, rows, starts, flips in zip(parts, self.rows, self.starts, masks, strict=True):
            values = flips ^ part
            low = starts[values]
            many = starts[values + 1] - low
            hit = many > 0
            low, many = low[hit], many[hit]
            ends = np.cumsum(many)
            found[rows[np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + many, many)]] = True
        rows = np.flatnonzero(found)
        apart = np.bitwise_count(self.codes[rows] ^ pack_bits(code[None])).sum(1)
        return rows[apart <= radius]


def _usable(profile: str) -> Column:
    """Arrays without nulls and non-finite values that are not zero throughout."""
    value = F.col(profile)
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(value, lambda x: x != 0), F.lit(False))


def _search(codes, k: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "class", "score"]
        if index.empty or queries.empty:
            return pd.DataFrame({name: [] for name in names}).astype({"query": "int64", "class": "int64", "score": float})
        learned = codes.value
        order = np.argsort(index["class"].to_numpy(), kind="stable")
        ids = index["class"].to_numpy()[order]
        vectors = np.stack(index["profile"].to_numpy()[order]).astype(np.float64)
        asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        table = SubstringIndex(learned.of(vectors))
        masks = table.masks(learned.radius)
        out = []
        for query, vector, code in zip(queries["query"], asked, learned.of(asked, True), strict=True):
            rows = table.within(code, learned.radius, masks)
            if len(rows) <= k:
                rows = np.arange(len(ids))  # too few so near: the radius grows to the whole shard
            scores = vectors[rows] @ vector
            if len(rows) > k + 1:
                edge = np.partition(-scores, k)[k]
                rows, scores = rows[-scores <= edge], scores[-scores <= edge]
            best = np.lexsort((ids[rows], -scores))[: k + 1]
            out.append(pd.DataFrame({"query": query, "class": ids[rows[best]], "score": scores[best]}))
        return pd.concat(out, ignore_index=True)

    return run


def similar_pieces(profiles: DataFrame, asked: Column, k: int = 20) -> DataFrame:
    """The ``k`` pieces whose profile has the largest inner product with that of each asked piece.

    ``profiles`` has ``piece_id`` (long) and ``profile``, an array of numbers of one
    length such as pitch-class weights; ``asked`` is a condition on ``piece_id``.
    Returns ``query_id``, ``rank`` (from 1), ``piece_id`` and ``score`` (double, of
    the given numbers); ties go to the smaller id, and a piece is not its own
    neighbour. Profiles that are null, zero, of another length than most, or hold null or non-finite
    numbers take no part, nor do rows without an id; a row repeated in full counts once.

    Equal profiles are one class, searched once. A class keeps its k+1 smallest
    ids, all that can ever be answered, since equal profiles tie. Classes are dealt to
    shards of about ``SHARD_ROWS``, and blocks of ``BLOCK_QUERIES`` asked classes meet
    every shard; a task holds one of each. Codes are learned on at most ``SAMPLE`` classes; all are indexed.
    """
    if k < 1:
        raise ValueError(f"k must be positive, not {k}")
    spark = profiles.sparkSession
    ship(spark)
    given = plain(profiles, "piece_id", "profile").withColumn("profile", F.col("profile").cast("array<double>"))
    rows = stored(given.filter(F.col("piece_id").isNotNull() & _usable("profile")), "profiles")
    sizes = rows.groupBy(F.size("profile").alias("n")).count().orderBy(F.desc("count"), "n").head()
    schema = "query_id long, rank int, piece_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("profile") == sizes["n"]).dropDuplicates(["piece_id", "profile"])
    first = Window.partitionBy("profile").orderBy("piece_id")
    classes = stored(
        rows.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .groupBy("profile")
        .agg(F.array_sort(F.collect_list("piece_id")).alias("ids"))
        .select(F.col("ids")[0].alias("class"), "ids", "profile"),
        "profile-classes",
    )
    squares = F.aggregate("profile", F.lit(0.0), lambda total, x: total + x * x)
    total, norm = classes.agg(F.count("*"), F.sqrt(F.max(squares))).head()
    sample = classes.select("profile").orderBy(F.xxhash64("class")).limit(SAMPLE).toArrow()
    vectors = np.array(sample["profile"].to_pylist(), np.float64)
    codes = spark.sparkContext.broadcast(learn(vectors, float(norm), total, k))

    wanted = stored(
        rows.filter(asked).join(classes.select("profile", "class"), "profile").select(
            F.col("piece_id").alias("query_id"), "class"
        ),
        "asked",
    )
    queries = classes.join(wanted.select("class").distinct(), "class", "left_semi").select(
        F.col("class").alias("query"), F.col("profile").alias("vector")
    )
    shards = -(-total // SHARD_ROWS)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = classes.select(
        "class", "profile", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard"), all_of(blocks).alias("block")
    )
    queries = queries.select(
        "query", "vector", all_of(shards).alias("to_shard"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("of_block")
    )
    found = (
        index.groupBy("shard", "block")
        .cogroup(queries.groupBy("to_shard", "of_block"))
        .applyInPandas(_search(codes, k), "query long, class long, score double")
    )
    ahead = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    best = found.withColumn("place", F.row_number().over(ahead)).filter(F.col("place") <= k + 1)
    answer = F.struct((-F.col("score")).alias("below"), F.col("id"))
    answers = stored(
        best.join(classes.select("class", "ids"), "class")
        .select("query", "score", F.explode("ids").alias("id"))
        .groupBy("query")
        .agg(F.slice(F.array_sort(F.collect_list(answer)), 1, k + 1).alias("nearest"))
        .withColumnRenamed("query", "class"),
        "answers",
    )
    codes.unpersist()
    others = F.filter("nearest", lambda a: a["id"] != F.col("query_id"))
    return (
        wanted.join(answers, "class")
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "found"))
        .select(
            "query_id",
            (F.col("place") + 1).cast("int").alias("rank"),
            F.col("found.id").alias("piece_id"),
            (-F.col("found.below")).alias("score"),
        )
    )
