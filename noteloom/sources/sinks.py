"""The stored corpus, and wide tables and payloads as CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.sources.catalogue import collection_of

LAYOUT = ["collection", "piece_id", "part", "seq"]


def wide(table: DataFrame, index: list[str], column: str, value: str, columns: list) -> DataFrame:
    """One column per part or voice pair; ``columns`` are given, so no extra job runs.

    A row of another part stops the job when the table is read: nothing is left out unsaid.
    """
    known = F.coalesce(F.col(column).isin(columns), F.lit(False))
    stray = F.raise_error(F.concat(F.lit(f"{column} is not among the columns: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    checked = table.withColumn(column, F.when(known, F.col(column)).otherwise(stray.cast(table.schema[column].dataType)))
    return checked.groupBy(*index).pivot(column, columns).agg(F.first(value, ignorenulls=True))


def long(table: DataFrame, index: list[str], columns: list[str], column: str, value: str) -> DataFrame:
    """The rows of a wide table again, one per cell that is not null."""
    return table.unpivot(index, columns, column, value).filter(F.col(value).isNotNull())


def write_csv(table: DataFrame, path: str, what: str, order: list[str] | None = None) -> None:
    """Write a table as CSV files, or the line ``No <what> found`` when it is empty."""
    if table.isEmpty():
        table.sparkSession.range(1).select(F.lit(f"No {what} found").alias("value")).write.mode("overwrite").text(path)
        return
    rows = table.orderBy(*order) if order else table
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(payload: dict[str, DataFrame], path: str) -> None:
    """Write each table of a payload as JSON lines under its own name."""
    for name, table in payload.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def write_events(events: DataFrame, path: str) -> None:
    """Store note events by collection, each file a range of pieces, parts and places.

    Ranges, unlike hashes, cut a giant piece into several files, and the order
    inside the files lets a scan skip the row groups of other pieces.
    """
    placed = events.withColumn("collection", F.coalesce(collection_of(F.col("piece_id")), F.lit("other")))
    ranged = placed.repartitionByRange(*LAYOUT).sortWithinPartitions(*LAYOUT)
    ranged.write.mode("overwrite").partitionBy("collection").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
