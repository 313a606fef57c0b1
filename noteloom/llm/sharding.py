"""Shards of score documents by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from noteloom.llm.columns import plain, stored, text_of
from noteloom.llm.shipping import ship

# Constants of the published jump hash: multiplier of its generator, and the numerator of its step.
GENERATOR = np.uint64(2862933555777941757)
STEP = float(1 << 31)


def key_of(piece_id: str = "piece_id") -> Column:
    """A stable 64-bit key of a piece, from the id alone; a null id counts as empty."""
    text = F.coalesce(F.col(piece_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key. No table of shards is kept; the last jump below ``shards`` decides."""
    state = keys.astype(np.uint64)
    chosen = np.zeros(len(state), np.int64)
    leap = np.zeros(len(state), np.int64)
    alive = leap < shards
    with np.errstate(over="ignore"):
        while alive.any():
            chosen[alive] = leap[alive]
            state[alive] = state[alive] * GENERATOR + np.uint64(1)
            draw = (state[alive] >> np.uint64(33)).astype(np.float64) + 1.0
            leap[alive] = ((chosen[alive] + 1) * (STEP / draw)).astype(np.int64)
            alive = leap < shards
    return chosen


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError(f"shards must be positive, not {shards}")

    @pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards).astype(np.int32))

    return of(key)


def shard_pieces(scores: DataFrame, shards: int = 16, stripes: int = 256) -> DataFrame:
    """Place every score document (piece_id, content) in one of ``shards`` shards.

    Returns a row per input row: ``piece_id``, ``n_bytes`` (UTF-8 bytes of the
    content plus one; null content has none), ``content_crc32``, ``shard``,
    ``slot`` (0, 1, ... without gaps inside the shard) and ``grown_shard`` (the
    shard if one more were there). The id and the number of shards alone decide,
    so one more shard only takes rows into itself; equal ids share a shard.

    Slots follow the content inside ``stripes`` slices of a shard, so neither a
    shard nor a repeated id is one task; slices are numbered from their counts,
    at most ``shards * stripes`` rows. Rows that agree in id, size and checksum are interchangeable.
    """
    ship(scores.sparkSession)
    text = F.col("content").cast("string")
    key = key_of()
    placed = stored(
        plain(scores, "piece_id", "content").select(
            "piece_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("n_bytes"),
            F.crc32(text_of()).alias("content_crc32"),
            shard_of(key, shards).alias("shard"),
            shard_of(key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shards",
    ).withColumn("stripe", F.pmod(F.xxhash64("piece_id", "content_crc32", "row"), F.lit(stripes)))
    slices = placed.groupBy("shard", "stripe").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("shard", "stripe", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "stripe").orderBy("piece_id", "n_bytes", "content_crc32", "row")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "stripe"]).select(
        "piece_id",
        "n_bytes",
        "content_crc32",
        "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        "grown_shard",
    )
