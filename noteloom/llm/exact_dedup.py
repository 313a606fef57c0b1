"""Exact duplicates against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row
per digest, meets the index in a sort-merge anti-join, and what is new is
appended. Everything runs as DataFrame operations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.columns import BLANKS, plain, stored, text_of

BUCKETS = 64


class DigestIndex:
    """Digests of the score documents seen so far and the piece that stands for each.

    ``name``     catalogue name of the table; an existing one is continued
    ``buckets``  files per append; fixed when the index is first written

    Columns of the table: ``digest`` (sha-256 of the document without white
    space), ``keep_id``, ``keep_row`` and ``batch``.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"not a table name: {name!r}")
        self.spark, self.name, self.buckets = spark, name, int(buckets)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget every digest; judgements already given stay readable."""
        self.spark.sql(f"drop table if exists {self.name} purge")

    def _write(self, digests: DataFrame) -> None:
        (
            digests.repartition(self.buckets, "digest")
            .write.mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def append(self, scores: DataFrame) -> DataFrame:
        """Judge a batch of ``scores`` (piece_id, content) and remember what is new.

        Returns one row per input row: ``piece_id``, ``keep_id`` (the piece that
        stays), ``group_size`` (rows of this batch with that text), ``kept`` and
        ``text_sha256``. Two documents are equal when they are the same after all
        blanks are deleted. Of equal ones the longest original stays, then the
        smallest piece_id (null before all others); of rows that repeat a piece
        exactly one stays. A text that the index knew before the batch keeps its
        earlier piece and all its rows go. Null content is an empty text, and empty texts are equal.
        """
        text = text_of()
        keyed = stored(
            plain(scores, "piece_id", "content").select(
                "piece_id",
                F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("digest"),
                (-F.char_length(text)).alias("shorter"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        found = stored(
            keyed.groupBy("digest")
            .agg(F.min(F.struct("shorter", "piece_id", "row")).alias("best"), F.count("*").alias("group_size"))
            .select(
                "digest",
                F.col("best.piece_id").alias("keep_id"),
                F.col("best.row").alias("keep_row"),
                "group_size",
            ),
            "digest-groups",
        )
        columns = ["digest", "keep_id", "keep_row", "batch"]
        if not self.exists():
            self._write(found.limit(0).select(*columns[:3], F.lit(0).alias("batch")))
        number = self.table().agg(F.coalesce(F.max("batch"), F.lit(-1))).head()[0] + 1
        fresh = found.select(*columns[:3], F.lit(number).alias("batch"))
        self._write(fresh.join(self.table().select("digest").hint("merge"), "digest", "left_anti"))
        known = self.table().select(*columns)
        found = stored(found.select("digest", "group_size").join(known.hint("merge"), "digest"), "digest-decisions")
        # Both sides are stored tables, so a text that many rows share is split when the join runs.
        return keyed.join(found, "digest").select(
            "piece_id",
            "keep_id",
            "group_size",
            ((F.col("row") == F.col("keep_row")) & (F.col("batch") == number)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
