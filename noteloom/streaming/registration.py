"""Registration of score files: named files at once, or files as they arrive.

Each registration is a batch written in three tables of a folder: ``scores``
(accepted files), ``rejected`` (with the reason) and ``elements`` (flattened
documents). Every try of a batch writes folders of its own; the batch counts once its number
stands in the ``log``, one small file a batch, written last and never over another. Readers see listed tries
only, in the order of their numbers, so neither a try that died nor the clocks of the writers matter. A
batch that the log has already is done: run again, it changes nothing, also after a later removal.

The log needs a file system that can refuse to create a file that exists, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteloom.sources import catalogue, mei

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _register(files: DataFrame, out: str, batch: str) -> None:
    """Validate documents (piece_id, path, n_bytes, content) and write one batch."""
    spark = files.sparkSession
    log = RegistryLog(spark, out)
    _plain_name(batch)
    if log.has(batch):
        return
    attempt = uuid.uuid4().hex

    def part(name: str) -> str:
        return f"{out}/{name}/batch={batch}/attempt={attempt}"

    # The name is settled once, before flattening; a name that two files of a batch claim is neither's.
    files = files.withColumn("piece_id", F.trim("piece_id"))
    claims = files.groupBy("piece_id").agg(F.count(F.lit(1)).alias("claims"))
    files = files.join(claims, "piece_id")
    clashing = files.filter("claims > 1")
    files = files.filter("claims = 1")
    mei.elements(files).write.mode("overwrite").parquet(part("elements"))
    rows = spark.read.schema(mei.ELEMENTS).parquet(part("elements"))
    named = files.select("piece_id", "path", "n_bytes", F.current_timestamp().alias("registered_at"))
    candidates = mei.scores(rows).join(named, "piece_id").withColumnRenamed("piece_id", "filename")
    accepted, rejected = catalogue.registrations(candidates)
    clashes = clashing.select(
        F.col("piece_id").alias("filename"), F.lit(False).alias("is_valid"),
        F.concat(F.col("claims").cast("string"), F.lit(" files of this batch claim the name")).alias("error"),
        "path", "n_bytes", F.current_timestamp().alias("registered_at"),
    )
    rejected = rejected.unionByName(clashes, allowMissingColumns=True)
    accepted.write.mode("overwrite").parquet(part("scores"))
    rejected.write.mode("overwrite").parquet(part("rejected"))
    log.commit(batch, attempt)


def register_files(spark: SparkSession, path: str, out: str, batch: str, filename: str | None = None) -> None:
    """Register the file or files at ``path``; a single file may be given a name."""
    files = mei.with_names(spark.read.format("binaryFile").load(path))
    if filename is not None:
        found = files.select("path").limit(2).count()
        if found != 1:
            raise ValueError(f"a name is for one file; {path} has {'several' if found else 'none'}")
        files = files.withColumn("piece_id", F.lit(filename.strip()))
    _register(files, out, batch)


def register_arrivals(spark: SparkSession, inbox: str, out: str, checkpoint: str) -> StreamingQuery:
    """Register every new ``*.mei`` file of ``inbox`` once, then stop."""
    arrivals = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.mei").load(inbox)
    )
    return (
        arrivals.writeStream.foreachBatch(
            lambda files, number: _register(mei.with_names(files), out, f"arrivals-{number:09d}")
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def unregister_files(spark: SparkSession, out: str, names: list[str], batch: str) -> None:
    """Take names out of the registry; a later registration of a name brings it back.

    The removal is a batch of its own: it takes out what the log lists before it.
    """
    log = RegistryLog(spark, out)
    _plain_name(batch)
    if log.has(batch):
        return
    attempt = uuid.uuid4().hex
    rows = spark.createDataFrame([(name.strip(),) for name in names], "filename string").distinct()
    rows.write.parquet(f"{out}/removed/batch={batch}/attempt={attempt}")
    log.commit(batch, attempt)


def _plain_name(batch: str) -> None:
    if not batch or set(batch) & set("/\\=*?{}[]"):
        raise ValueError(f"not a batch name: {batch!r}")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class RegistryLog:
    """Numbered entries of a registry: which try of which batch counts, in what order.

    An entry is a file named by its number that holds the batch and its try. A writer takes the number after
    the last one it sees; if another writer was first, it looks again. Nothing is ever changed or deleted; an
    entry whose writer died before it was filled says nothing.
    """

    SCHEMA = "number bigint, batch string, attempt string"

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.folder = spark, f"{out}/log"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> DataFrame:
        """The entry of every batch, read as a table: the first, should two writers have listed one batch at once."""
        if not self._files.exists(self._path(self.folder)):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).json(self.folder).filter("batch is not null")
        first = rows.groupBy("batch").agg(F.min("number").alias("number"), F.min_by("attempt", "number").alias("attempt"))
        return first.select("number", "batch", "attempt")

    def has(self, batch: str) -> bool:
        return not self.entries().filter(F.col("batch") == batch).isEmpty()

    def _next(self) -> int:
        if not self._files.exists(self._path(self.folder)):
            return 1
        names = [found.getPath().getName() for found in self._files.listStatus(self._path(self.folder))]
        return 1 + max([int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdecimal()], default=0)

    def commit(self, batch: str, attempt: str) -> int | None:
        """Give the try the next number; None when another try of the batch has one."""
        while True:
            number = self._next()
            if self.has(batch):
                return None
            try:
                stream = self._files.create(self._path(f"{self.folder}/{number:012d}.json"), False)
            except Py4JJavaError as problem:
                if "already exists" not in str(problem.java_exception):
                    raise
                continue
            stream.write(bytearray(json.dumps({"number": number, "batch": batch, "attempt": attempt}).encode()))
            stream.close()
            return number


def _listed(spark: SparkSession, out: str, table: str, columns: str) -> DataFrame | None:
    """Rows of a table's listed tries with the ``number`` and ``batch`` of each; None where the table was never written."""
    if not _exists(spark, f"{out}/{table}"):
        return None
    rows = spark.read.schema(f"{columns}, batch string, attempt string").parquet(f"{out}/{table}")
    return rows.join(RegistryLog(spark, out).entries(), ["batch", "attempt"])


def registered_scores(spark: SparkSession, out: str) -> DataFrame:
    """The latest accepted registration of every name that has not been removed since."""
    scores = _listed(spark, out, "scores", "filename string, path string, n_bytes bigint")
    removed = _listed(spark, out, "removed", "filename string")
    if scores is None:
        return spark.createDataFrame([], "filename string, number bigint, batch string, attempt string, path string, n_bytes bigint")
    kept = ["filename", "number", "batch", "attempt", "path", "n_bytes"]
    added = scores.select(*kept, F.lit(True).alias("added"))
    if removed is not None:
        added = added.unionByName(removed.select("filename", "number", F.lit(False).alias("added")), allowMissingColumns=True)
    return catalogue.latest_changes(added).select(*kept)


def with_registered(builtin: DataFrame, out: str) -> DataFrame:
    """Flattened built-in documents with registered ones in place of their namesakes."""
    spark = builtin.sparkSession
    chosen = registered_scores(spark, out).select(F.col("filename").alias("piece_id"), "attempt")
    rows = spark.read.schema(f"{mei.ELEMENTS}, batch string, attempt string").parquet(f"{out}/elements")
    own = rows.join(chosen, ["piece_id", "attempt"])
    kept = builtin.join(chosen.select("piece_id"), "piece_id", "left_anti")
    columns = builtin.columns
    return kept.select(*columns).unionByName(own.select(*columns))
