"""Lines that many score documents share, kept as levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteloom.llm.columns import BLANKS, forget, plain, stored, text_of
from noteloom.llm.shipping import map_arrow
from noteloom.session import shared_folder

FANOUT = 4
BATCH_ROWS = 1 << 16

_STRIP = BLANKS.encode()
_HASH = "line_hi long, line_lo long"
_KEY = ["line_hi", "line_lo"]
_TEXT = "text_hi long, text_lo long"


def line_hash(line: bytes) -> tuple[int, int]:
    """128-bit hash of a line's key: blanks stripped at both ends, A-Z in lower case."""
    value = xxhash.xxh3_128_intdigest(line.strip(_STRIP).lower())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def is_blank(line: bytes) -> bool:
    return not line.strip(_STRIP)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct line hashes of each document, with the document's other columns."""
    for batch in batches:
        schema = batch.schema
        names = [name for name in schema.names if name != "content"]
        at, hi, lo = [], [], []

        def flush() -> pa.RecordBatch:
            columns = [batch.column(name).take(pa.array(at, pa.int64())) for name in names]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], [*names, "line_hi", "line_lo"]
            )

        for row, content in enumerate(batch.column(schema.get_field_index("content"))):
            lines = content.as_py().split(b"\n")
            for key in {line_hash(line) for line in set(lines) if not is_blank(line)}:
                at.append(row)
                hi.append(key[0])
                lo.append(key[1])
                if len(at) >= BATCH_ROWS:
                    yield flush()
                    at, hi, lo = [], [], []
        if at:
            yield flush()


@dataclass(frozen=True)
class Run:
    level: int
    path: str


class LineRuns:
    """Levelled runs of (line hash, number of documents) under one folder.

    A batch is reduced to one row per line and meets the runs before it in a sort-merge anti-join: lines that no run
    has are new, with the documents of this batch; the others are added counts of lines that an earlier run has. Both go into
    one run at level 0, told apart by ``is_new``, so a line is new in exactly one run. When a level holds ``fanout``
    runs they are merged into one run of the next level, so a line is rewritten once per level.
    Every run is written by line hash and sorted inside its files. The list of
    runs is a small table of its own that is written after the run, under a rising version: a job that
    dies leaves at most a run that nobody lists, and the folder can be opened again. Without a ``folder`` the runs
    are those of one application and go with its stored tables.
    """

    SCHEMA = f"{_HASH}, n_pieces long, is_new boolean"

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError(f"fanout must be at least 2, not {fanout}")
        root = folder or shared_folder(spark)
        if root is None:
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        self.spark, self.fanout = spark, fanout
        self.folder = folder or f"{root}/noteloom/{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex}"
        self.version, self.runs = self._listed()

    def _listed(self) -> tuple[int, list[Run]]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/list")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0, []
        rows = self.spark.read.schema("version int, level int, path string").parquet(f"{self.folder}/list/*")
        newest = rows.agg(F.max("version")).head()[0] or 0
        found = rows.filter((F.col("version") == newest) & F.col("path").isNotNull()).orderBy("level", "path")
        return newest, [Run(row["level"], row["path"]) for row in found.collect()]

    def _list(self, runs: list[Run]) -> None:
        version = self.version + 1
        rows = [(version, run.level, run.path) for run in runs]
        table = self.spark.createDataFrame(rows, "version int, level int, path string")
        table.coalesce(1).write.parquet(f"{self.folder}/list/{version}")
        self.version, self.runs = version, sorted(runs, key=lambda run: (run.level, run.path))

    def _write(self, counts: DataFrame, level: int) -> Run:
        path = f"{self.folder}/level-{level}/{self.version:09d}-{uuid.uuid4().hex}"
        counts.sortWithinPartitions("line_hi", "line_lo").write.parquet(path)
        return Run(level, path)

    def _rows(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[run.path for run in runs])

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEY).agg(F.sum("n_pieces").alias("n_pieces"), F.bool_or("is_new").alias("is_new"))

    def read(self, runs: list[Run] | None = None) -> DataFrame:
        """Counts over all runs (or the given ones), one row per line hash."""
        return self._merged(self._rows(self.runs if runs is None else runs)).drop("is_new")

    def against_runs(self, counts: DataFrame) -> DataFrame:
        """The run that a batch's ``counts`` (one row per line) add: new lines by an anti-join, counts of known ones beside them."""
        if not self.runs:
            return counts.withColumn("is_new", F.lit(True))
        known = self._rows(self.runs).filter("is_new").select(*_KEY).hint("merge")
        new = counts.join(known, _KEY, "left_anti").withColumn("is_new", F.lit(True))
        return new.unionByName(counts.join(known, _KEY, "left_semi").withColumn("is_new", F.lit(False)))

    def add(self, scores: DataFrame) -> None:
        """Add a batch of scores (piece_id, content) as one new run and compact full levels."""
        counts = _hashed(scores.select("content"), "").groupBy(*_KEY).agg(F.count("*").alias("n_pieces"))
        if self.runs:
            # Stored, so that texts are split once and lines are reduced before they meet the runs.
            counts = stored(counts, "batch-lines")
            self._list([*self.runs, self._write(self.against_runs(counts), 0)])
            forget(counts)
        else:
            self._list([self._write(self.against_runs(counts), 0)])
        level = 0
        while len(full := [run for run in self.runs if run.level == level]) >= self.fanout:
            merged = self._write(self._merged(self._rows(full)), level + 1)
            self._list([run for run in self.runs if run.level != level] + [merged])
            level += 1

    def common(self, min_pieces: int) -> DataFrame:
        """Hashes of the lines found in at least ``min_pieces`` documents of all batches.

        A line is new in one run; only what later batches added to known lines is summed before it meets them.
        """
        rows = self._rows(self.runs)
        added = rows.filter(~F.col("is_new")).groupBy(*_KEY).agg(F.sum("n_pieces").alias("added"))
        counted = rows.filter("is_new").join(added, _KEY, "left")
        return counted.filter(F.col("n_pieces") + F.coalesce("added", F.lit(0)) >= min_pieces).select(*_KEY)


def _hashed(df: DataFrame, others: str) -> DataFrame:
    schema = StructType.fromDDL(", ".join(filter(None, [others, _HASH])))
    return map_arrow(df.withColumn("content", F.encode(text_of(), "utf-8")), _line_rows, schema)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        drops = batch.column(batch.schema.get_field_index("drops"))
        texts = batch.column(batch.schema.get_field_index("content"))
        total, dropped, kept = [], [], []
        for text, drop in zip(texts, drops, strict=True):
            lines = text.as_py().split(b"\n")
            total.append(len(lines))
            if drop.is_valid:
                gone = {(d["hi"], d["lo"]) for d in drop.as_py()}
                lines = [line for line in lines if is_blank(line) or line_hash(line) not in gone]
            dropped.append(total[-1] - len(lines))
            kept.append(b"\n".join(lines).decode())
        names = [name for name in batch.schema.names if name not in ("drops", "content")]
        columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
            [*names, "n_lines", "n_dropped", "kept"],
        )


def drop_common_lines(
    scores: DataFrame, runs: LineRuns, min_pieces: int = 10, batches: int = 1, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Take from every score document the lines that at least ``min_pieces`` documents share.

    ``scores`` has ``piece_id`` and ``content``. A line's key has the blanks at
    both ends stripped and A-Z lowered; lines without a key always stay. A row is
    a document, also when its id repeats. The documents are first added to ``runs``
    in ``batches`` runs, each anti-joined with those before it, so earlier batches count too; then the
    lines meet what the runs have in common. Returns ``piece_id``, ``n_lines``, ``n_dropped``,
    ``kept`` (the other lines joined by line feeds) and the columns named in
    ``carry``. Null or empty content is one empty line.

    Each text needs its own hashes only: copies of a text share one list, joined
    by a 128-bit text hash, so ids need not be unique.
    """
    if batches < 1 or min_pieces < 1:
        raise ValueError(f"batches and min_pieces must be positive, not {batches} and {min_pieces}")
    work = plain(scores, "piece_id", "content", *carry)
    text = text_of()
    keys = {"text_hi": F.xxhash64(text), "text_lo": F.xxhash64(F.lit(1), text)}
    for number in range(batches):
        runs.add(work.filter(F.pmod(F.xxhash64("content"), F.lit(batches)) == number) if batches > 1 else work)
    common = stored(runs.common(min_pieces), "common-lines")
    lines = _hashed(work.select(*[col.alias(name) for name, col in keys.items()], "content"), _TEXT)
    gone = stored(
        lines.join(common, _KEY, "left_semi")
        .groupBy("text_hi", "text_lo")
        .agg(F.collect_set(F.struct(F.col("line_hi").alias("hi"), F.col("line_lo").alias("lo"))).alias("drops")),
        "dropped-lines",
    )
    joined = work.withColumns({**keys, "content": F.encode(text, "utf-8")}).join(gone, ["text_hi", "text_lo"], "left")
    fields = StructType([f for f in work.schema.fields if f.name != "content"])
    for name, kind in (("n_lines", "long"), ("n_dropped", "long"), ("kept", "string")):
        fields = fields.add(name, kind)
    return map_arrow(joined.select("piece_id", *carry, "content", "drops"), _without, fields)
