"""Stored intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from noteloom.session import shared_folder

_stored: dict[tuple[str, str], tuple[str, str, StructType]] = {}


def _folder(spark: SparkSession) -> str:
    root = shared_folder(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return f"{root}/noteloom/{spark.sparkContext.applicationId}"


def _write(df: DataFrame, name: str) -> str:
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, lets later scans prune columns, and survives the loss
    of executors. A cluster that names no shared folder is an error: without stored tables
    the plans that build on one another would read and parse their input many times.
    """
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(_write(df, name))


def _state(spark: SparkSession, sources: tuple[str, ...]) -> str:
    """What tells sources from rewritten ones: when each was last changed, and its size if it is a file.

    That is one question a source, however many files a folder holds; writing into a folder changes its time.
    """
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(source) for source in sources]
    found = [path.getFileSystem(conf).getFileStatus(path) for path in paths]
    return " ".join(f"{f.getPath()} {f.getModificationTime()} {f.getLen()}" for f in found)


def stored_once(spark: SparkSession, name: str, build: Callable[[], DataFrame], *sources: str) -> DataFrame:
    """The stored table ``name`` of this application, built on first use and again when one of its ``sources`` changes.

    ``sources`` are the paths of the files or folders that ``build`` reads; no plan is made while they stay as they are.
    """
    state = _state(spark, sources)
    slot = (spark.sparkContext.applicationId, name)
    if slot not in _stored or _stored[slot][0] != state:
        df = build()
        _stored[slot] = (state, _write(df, "table"), df.schema)
    _, path, schema = _stored[slot]
    return spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application has stored; call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    app = spark.sparkContext.applicationId
    for slot in [slot for slot in _stored if slot[0] == app]:
        del _stored[slot]
