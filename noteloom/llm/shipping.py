"""Python code for the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

import noteloom

_shipped: set[str] = set()

#: Bytes of the rows that a function sees, and answers, at once.
SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Functions then travel by name, so what a worker has loaded, such as a
    vocabulary, stays loaded between tasks. The archive is served by the driver.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(noteloom.__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="noteloom-code-"), "noteloom_code.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(home.rglob("*.py")):
            packed.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some ``SLICE_BYTES``, a row at least, so that what a function makes of one stays small."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors and batches of bounded size."""
    ship(df.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches))

    return df.mapInArrow(bounded, schema)
