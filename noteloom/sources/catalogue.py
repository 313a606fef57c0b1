"""The catalogue of scores: names, collections, registrations, piece lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators.ordered import BLOCK_ROWS, block_of, running

# File-name prefixes and the collections they stand for, and the two
# lists that cut across them.
COLLECTIONS = {
    "Bach": "bach_inventions",
    "Bartok": "bartok_mikrokosmos",
    "Morley": "morley_canzonets",
    "CRIM": "crim_corpus",
}
REGISTERED_FILES, ALL_FILES = "uploaded_mei_files", "all_files"

# Blocks of positions that a piece list counts together.
STRIP_BLOCKS = 1 << 10

BUILTIN, REGISTERED = "builtin", "registered"


def collection_of(filename: Column) -> Column:
    filename = basename(filename)
    found = F.lit(None).cast("string")
    for prefix, name in COLLECTIONS.items():
        found = F.when(filename.startswith(prefix), F.lit(name)).otherwise(found)
    return found


def name_error(filename: Column) -> Column:
    """Why a name cannot be registered; null when it can."""
    name = F.trim(filename)
    return (
        F.when(name.isNull() | (name == ""), F.lit("a score needs a file name"))
        .when(name.isin(".", "..") | name.rlike(r"[/\\]"), F.lit("the file name may not be a path"))
        .when(~F.lower(name).endswith(".mei"), F.lit("the file name lacks the ending .mei"))
    )


def basename(filename: Column) -> Column:
    return F.element_at(F.split(filename, "/"), -1)


def registrations(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (filename, path, is_valid, error) into accepted scores and rejects."""
    checked = candidates.withColumns({
        "filename": F.trim("filename"),
        "error": F.coalesce(name_error(F.col("filename")), F.col("error")),
    })
    accepted = checked.filter("error is null and is_valid").withColumn("source", F.lit(REGISTERED))
    return accepted.drop("error", "is_valid"), checked.filter("error is not null or not is_valid")


def resolve(scores: DataFrame) -> DataFrame:
    """One row per file name; a registered score shadows a built-in one.

    Among registrations of one name the latest (``registered_at``) wins.
    """
    rank = F.struct(
        (F.col("source") == REGISTERED).alias("own"), F.col("registered_at"), F.col("path")
    )
    chosen = scores.groupBy(basename(F.col("filename")).alias("filename")).agg(
        F.max(F.struct(rank.alias("rank"), "source")).alias("best")
    )
    return chosen.select("filename", "best.source", F.col("best.rank.path").alias("path"))


def collections(scores: DataFrame, ordered: bool = False) -> DataFrame:
    """Every name under its collection, under the registered list, and in all files; ``ordered`` for display."""
    builtin = scores.filter(F.col("source") == BUILTIN)
    named = builtin.select(collection_of(F.col("filename")).alias("collection"), "filename").filter(
        "collection is not null"
    )
    own = scores.filter(F.col("source") == REGISTERED).select(F.lit(REGISTERED_FILES).alias("collection"), "filename")
    everything = scores.select(F.lit(ALL_FILES).alias("collection"), "filename")
    listed = named.unionByName(own).unionByName(everything).distinct()
    return listed.orderBy("collection", "filename") if ordered else listed


def collection_counts(scores: DataFrame) -> DataFrame:
    return collections(scores).groupBy("collection").agg(F.count(F.lit(1)).alias("files"))


def registered(scores: DataFrame, ordered: bool = False) -> DataFrame:
    names = scores.filter(F.col("source") == REGISTERED).select("filename").distinct()
    return names.orderBy("filename") if ordered else names


def unregister(scores: DataFrame, names: DataFrame) -> DataFrame:
    """The catalogue without the registrations named in ``names`` (filename)."""
    gone = names.select("filename").distinct()
    kept = scores.filter(F.col("source") == REGISTERED).join(gone, "filename", "left_anti")
    return scores.filter(F.col("source") != REGISTERED).unionByName(kept)


def latest_changes(changes: DataFrame) -> DataFrame:
    """What a registry holds after all ``changes``: the last one of every name, where it added the name.

    ``changes`` has ``filename``, ``number`` (the order of the changes) and ``added`` (false: removed), among other columns.
    Of changes under one number a removal counts as the later; a name is one aggregated row, however often it changed.
    """
    others = [name for name in changes.columns if name not in ("filename", "number", "added")]
    last = F.max_by(F.struct("number", "added", *others), F.struct("number", ~F.col("added"))).alias("last")
    return changes.groupBy("filename").agg(last).select("filename", "last.*").filter("added")


def as_json(scores: DataFrame, ordered: bool = False) -> DataFrame:
    """One JSON record per file of the catalogue; ``ordered`` for display."""
    return collections(scores, ordered).select(F.to_json(F.struct("collection", "filename")).alias("record"))


def raw_document(documents: DataFrame, filename: str) -> DataFrame:
    return documents.filter(F.col("piece_id") == filename).select(
        "piece_id", F.col("content").cast("string").alias("document")
    )


def raw_documents(documents: DataFrame, names: DataFrame) -> DataFrame:
    """The documents whose name is among ``names`` (``piece_id``), as they were read; a name that repeats counts once."""
    wanted = names.select("piece_id")
    return documents.join(wanted, "piece_id", "left_semi").select("piece_id", F.col("content").cast("string").alias("document"))


def piece_list(names: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the distinct non-empty names of (pos, name) in order of first appearance.

    Positions are cut into blocks, blocks into strips of as many blocks, and running counts go from
    strip to block to row: with n positions no window holds more than the square root of n / block_rows rows of counts.
    """
    firsts = names.filter("name is not null and name != ''").groupBy("name").agg(F.min("pos").alias("pos"))
    cut = firsts.withColumn("strip", F.expr(f"cast(pos div {block_rows * STRIP_BLOCKS} as bigint)"))
    strips = running(
        cut.groupBy("strip").agg(F.count(F.lit(1)).alias("names")).withColumn("all", F.lit(0)),
        ["all"], ["strip"], block_of("strip", STRIP_BLOCKS), sums={"earlier": F.col("names")},
    )
    inside = running(cut, ["strip"], ["pos"], block_of("pos", block_rows), sums={"place": F.lit(1)})
    numbered = inside.join(strips.select("strip", "earlier"), "strip")
    return numbered.select(F.col("name").alias("piece_id"), (F.col("earlier") + F.col("place")).cast("bigint").alias("score_index"))


def named_pieces(spark: SparkSession, filename: str | None = None, filenames: list[str] | None = None) -> DataFrame:
    """The piece list of a request that names one score, several, or both."""
    given = [n for n in [filename, *(filenames or [])] if n]
    if not given:
        raise ValueError("no score is named")
    return piece_list(spark.createDataFrame(list(enumerate(given)), "pos bigint, name string"))
