"""Column expressions and checks shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.session import shared_folder
from noteloom.sources.tables import store

# The white space every operator here knows: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"


def text_of(content: str = "content") -> Column:
    """The document as text; null counts as empty."""
    return F.coalesce(F.col(content).cast("string"), F.lit(""))


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage.

    The operators read such tables more than once and rely on row numbers that
    were written with them, so a cluster must name a shared folder. Shuffle files of the
    write go when it ends, not only when the driver collects its garbage.
    """
    spark = df.sparkSession
    if shared_folder(spark) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return store(df, name)
    finally:
        spark.conf.set(CLEAN_UP, before)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of a table cannot clash."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; the table has {df.columns}")
    return df.select(*names)
