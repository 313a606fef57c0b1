"""Near-duplicate score documents by a grouped prefix join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from noteloom.llm.columns import forget, plain, stored, text_of
from noteloom.llm.components import components
from noteloom.llm.shipping import map_arrow

SKETCH_BITS = 18
LONG_LIST = 32
HUBS = 4
WANTED_BITS = 22


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text.

    Words are separated by blanks and A-Z is lowered. A text with fewer words
    than ``width`` has one shingle, all its words; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - width + 1
    mixed = np.full(last, width, np.uint64)
    with np.errstate(over="ignore"):
        for place in range(width):
            mixed = (mixed ^ hashed[place : place + last]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def prefix_size(size: int, percent: int) -> int:
    """Shingles of which two similar sets share at least one, in any common order."""
    return size - (-(-percent * size // 100)) + 1


def _signed(value: int) -> int:
    return value - (1 << 63)


def _pair(data: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(data)
    return _signed(value >> 64), _signed(value & ((1 << 64) - 1))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                places = (shingles(text.as_py(), width) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                if len(places) > 4096:
                    counts += np.bincount(places, minlength=len(counts))
                else:
                    np.add.at(counts, places, 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    return run


def _profile(width: int, percent: int, ranks):
    """Size, set key, group key and prefix of each document; prefixes hold the rarest shingles first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = ranks.value
        for batch in batches:
            sizes, keys, prefixes = [], [], []
            for text in batch.column(batch.schema.get_field_index("content")):
                found = shingles(text.as_py(), width)
                count = common[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                rare = found[np.lexsort((found, count))][: prefix_size(len(found), percent) if len(found) else 0]
                sizes.append(len(found))
                keys.append((*_pair(found.tobytes()), *_pair(len(found).to_bytes(8, "little") + rare.tobytes())))
                prefixes.append(rare.view(np.int64))
            names = [name for name in batch.schema.names if name != "content"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(name)) for name in names],
                    pa.array(sizes, pa.int64()),
                    *[pa.array(column, pa.int64()) for column in zip(*keys, strict=True)],
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                [*names, "n", "set_hi", "set_lo", "group_hi", "group_lo", "prefix"],
            )

    return run


def _sets(width: int, wanted):
    """Shingles of the documents whose text may be wanted: the bit of its hash is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = np.flatnonzero(bits[batch.column(0).to_numpy() & (len(bits) - 1)])
            if not len(at):
                continue
            chosen = batch.take(pa.array(at))
            found = [shingles(text.as_py(), width).view(np.int64) for text in chosen.column(2)]
            yield pa.RecordBatch.from_arrays(
                [chosen.column(0), chosen.column(1), pa.array(found, pa.list_(pa.int64()))], ["text_hi", "text_lo", "found"]
            )

    return run


def _needed(percent: int, a: str, b: str) -> Column:
    """Shingles that sets of the two sizes share at least when they are similar."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _linked(pairs: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the class pairs (a, b) whose whole sets are similar.

    The sets are made again from the texts of the pairs' classes. A pair first fetches one of its sets and takes it
    to the other, so one set a pair is moved, and the two are compared in the join without being
    gathered; a class with very many pairs is a skewed side that the join splits. A bitmap of
    2^22 hash bits (4 MB) spares most other texts; the join itself is exact.
    """
    spark = pairs.sparkSession
    pairs = stored(pairs.distinct(), "pairs")
    keys = members.select("class", "text_hi", "text_lo")
    ends = stored(
        pairs.join(keys.toDF("a", "hi_a", "lo_a"), "a").join(keys.toDF("b", "hi_b", "lo_b"), "b"), "pair-ends"
    )

    def bit(text: str) -> Column:
        return F.col(text).bitwiseAND((1 << WANTED_BITS) - 1).cast("int").alias("bit")

    used = ends.select(bit("hi_a")).union(ends.select(bit("hi_b"))).distinct().toArrow()
    bits = np.zeros(1 << WANTED_BITS, bool)
    bits[used["bit"].to_numpy()] = True
    wanted = spark.sparkContext.broadcast(bits)
    sets = map_arrow(
        texts.select("text_hi", "text_lo", "content"), _sets(width, wanted), "text_hi long, text_lo long, found array<long>"
    )

    # Rows that repeat in full have one key: each key's set is taken once before pairs meet it.
    sets = sets.groupBy("text_hi", "text_lo").agg(F.first("found").alias("found"))
    one = sets.toDF("hi_a", "lo_a", "in_a").join(ends, ["hi_a", "lo_a"]).select("a", "b", "hi_b", "lo_b", "in_a")
    both = sets.toDF("hi_b", "lo_b", "in_b").join(one, ["hi_b", "lo_b"])
    shared = both.select("a", "b", F.size("in_a").alias("n_a"), F.size("in_b").alias("n_b"),
                         F.size(F.array_intersect("in_a", "in_b")).alias("shared"))
    similar = 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))
    links = stored(shared.filter(similar).select("a", "b"), "links")
    wanted.unpersist()
    forget(pairs, ends)
    return links


def near_pieces(scores: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of score documents (piece_id, content) that are linked by similar wording.

    Two documents link when ``100 * intersection >= percent * union`` of their
    distinct ``width``-word shingles. Returns per row ``piece_id``, ``n_shingles``
    and ``component_id``, the smallest piece_id reachable over links. Documents
    without words are linked with nothing, so is null content; equal sets are linked.
    Shingles are compared by 64-bit hashes.

    Documents of one set are a class; classes of one size and prefix are a group.
    Groups meet where prefixes share a shingle and sizes and places allow
    enough overlap. The order of shingles is rare first, by counts of all documents
    in 2^18 hash buckets (2 MB, whatever the corpus); any order gives the same links.
    Groups of lists up to ``LONG_LIST`` meet in pairs. In longer lists each group first meets the few groups of the
    list that place the shingle first, the least altered copies; what links gets
    one label. Then every pair of groups with different labels is met in full, so
    no component is missed, while the pairs inside a large group of copies are not made.
    """
    if width < 1 or not 1 <= percent <= 100:
        raise ValueError(f"width must be positive and percent within 1..100, not {width} and {percent}")
    spark = scores.sparkSession
    text = text_of()
    named = plain(scores, "piece_id", "content")
    work = named.select(F.encode(text, "utf-8").alias("content"))
    counted = map_arrow(work, _sketch(width), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    ranks = np.zeros(1 << SKETCH_BITS, np.int64)
    ranks[table["bucket"].to_numpy()] = table["n"].to_numpy()
    shared = spark.sparkContext.broadcast(ranks)

    source = {
        "row": F.monotonically_increasing_id(),
        "text_hi": F.xxhash64(text),
        "text_lo": F.xxhash64(F.lit(1), text, "piece_id"),
    }
    keyed = named.select("piece_id", *[c.alias(n) for n, c in source.items()], F.encode(text, "utf-8").alias("content"))
    fields = StructType([f for f in keyed.schema.fields if f.name != "content"])
    for name in ("n", "set_hi", "set_lo", "group_hi", "group_lo"):
        fields = fields.add(name, "long")
    profiles = stored(
        map_arrow(keyed, _profile(width, percent, shared), fields.add("prefix", ArrayType(LongType()))), "profiles"
    )
    worded = profiles.filter("n > 0")
    held = ("row", "n", "text_hi", "text_lo", "group_hi", "group_lo")
    classes = stored(
        worded.groupBy("set_hi", "set_lo")
        .agg(F.min(F.struct(*held)).alias("one"), F.min("piece_id").alias("first_id"))
        .select("set_hi", "set_lo", "first_id", "one.*")
        .withColumnRenamed("row", "class"),
        "classes",
    )
    groups = stored(
        worded.groupBy("group_hi", "group_lo")
        .agg(F.min("row").alias("group"), F.first("n").alias("n"), F.first("prefix").alias("prefix")),
        "groups",
    )
    members = stored(
        classes.join(groups.select("group_hi", "group_lo", "group"), ["group_hi", "group_lo"]).select(
            "class", "group", "n", "text_hi", "text_lo"
        ),
        "members",
    )
    postings = groups.select("group", "n", F.posexplode("prefix").alias("place", "shingle"))
    lists = stored(postings.groupBy("shingle").agg(F.count("*").alias("many")).filter("many > 1"), "lists")
    entries = stored(postings.join(lists, "shingle"), "entries")
    forget(groups, lists)

    def near_enough(a: str, b: str) -> Column:
        """Whether sizes and places of a shared shingle leave room for enough overlap."""
        n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
        room = F.least(n_a - F.col(f"place_{a}"), n_b - F.col(f"place_{b}"))
        sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
        return sizes & (room >= _needed(percent, f"n_{a}", f"n_{b}"))

    def side(table: DataFrame, which: str, *names: str) -> DataFrame:
        return table.select("shingle", *[F.col(c).alias(f"{c}_{which}") for c in (*names, "group", "n", "place")])

    def smaller(table: DataFrame) -> DataFrame:
        """What can be the smaller of two groups, or equal: its place leaves room for its own size at least."""
        return table.filter(F.col("n") - F.col("place") >= F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)))

    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("group_a") < F.col("group_b")))

    # Short lists: their pairs of groups. Long lists: stars, each group with the least altered groups of the list.
    short = entries.filter(F.col("many") <= LONG_LIST)
    # Prefixes that end at places p share c shingles, and the sets at most c + max(n_a - p_a, n_b - p_b): what lies
    # behind the prefix that ends first. Shingles of long lists are not counted here, so all of them may be shared.
    in_long = stored(
        entries.filter(F.col("many") > LONG_LIST).groupBy("group").agg(F.count("*").alias("long")), "in-long-lists"
    )

    def behind(n: str) -> Column:
        return F.ceil(F.lit(percent) * F.col(n) / 100) - 1

    counted_pairs = (
        side(short, "a").join(side(short, "b"), "shingle")
        .filter(ordered & (100 * F.col("n_a") >= percent * F.col("n_b")))
        .groupBy("group_a", "group_b", "n_a", "n_b")
        .agg(F.count("*").alias("shared"), F.max(near_enough("a", "b")).alias("placed"))
        .filter("placed")
        .join(in_long.select(F.col("group").alias("group_a"), F.col("long").alias("long_a")), "group_a", "left")
        .join(in_long.select(F.col("group").alias("group_b"), F.col("long").alias("long_b")), "group_b", "left")
    )
    at_most = F.col("shared") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    short_pairs = stored(
        counted_pairs.filter(at_most + F.greatest(behind("n_a"), behind("n_b")) >= _needed(percent, "n_a", "n_b"))
        .select("group_a", "group_b"),
        "short-pairs",
    )
    forget(in_long)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent) + 1e-9)) if percent < 100 else F.col("n")
    long_lists = entries.filter(F.col("many") > LONG_LIST).withColumn("band", band)
    hubs = stored(
        long_lists.withColumn("turn", F.pmod(F.xxhash64("group"), F.lit(HUBS)))
        .groupBy("shingle", "band", "turn")
        .agg(F.min(F.struct("place", "group", "n")).alias("hub"))
        .select("shingle", "band", *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("group", "n", "place")]),
        "hubs",
    )
    stars = stored(
        side(long_lists, "a", "band").withColumnRenamed("band_a", "band").join(hubs, ["shingle", "band"])
        .filter((F.col("group_a") != F.col("group_b")) & near_enough("a", "b"))
        .select("group_a", "group_b").distinct(),
        "stars",
    )

    # A group's first class stands for it: both have the smallest row. Classes of a group meet its first.
    pairs = short_pairs.union(stars).toDF("a", "b")
    inner = members.filter("class <> group").select(F.col("class").alias("a"), F.col("group").alias("b"))
    first_links = _linked(pairs.union(inner), members, keyed, width, percent)
    labels = components(first_links)

    # Then, in full, what may be similar and is not yet under one label: groups of long lists, and the
    # classes of groups that were met by their first classes alone.
    labelled = stored(
        members.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
            "class", "group", "n", F.coalesce("label", "class").alias("label")
        ),
        "labelled",
    )
    forget(labels)
    nodes = stored(labelled.groupBy("group", "label").agg(F.count("*").alias("classes")), "nodes")
    placed = stored(long_lists.join(nodes, "group").select("shingle", "group", "n", "place", "label"), "placed")
    open_lists = placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_lists = stored(open_lists.filter("low < high").select("shingle"), "open-lists")
    placed = stored(placed.join(open_lists, "shingle", "left_semi"), "placed-open")
    across = (
        side(smaller(placed), "a", "label").join(side(placed, "b", "label"), "shingle")
        .filter((F.col("label_a") != F.col("label_b")) & ordered & near_enough("a", "b"))
        .select("group_a", "label_a", "group_b", "label_b")
    )
    left = nodes.select(F.col("group").alias("group_a"), F.col("label").alias("label_a"))
    right = nodes.select(F.col("group").alias("group_b"), F.col("label").alias("label_b"))
    shared_group = nodes.groupBy("group").agg(F.count("*").alias("labels"), F.sum("classes").alias("all")).filter("all > 1")
    shared_group = stored(shared_group.select("group", "labels"), "shared-groups")
    several = shared_group.select("group")
    touched = short_pairs.join(several.withColumnRenamed("group", "group_a"), "group_a", "left_semi").union(
        short_pairs.join(several.withColumnRenamed("group", "group_b"), "group_b", "left_semi").select("group_a", "group_b")
    )
    retried = (
        touched.distinct().join(left, "group_a").join(right, "group_b").filter("label_a <> label_b")
        .select("group_a", "label_a", "group_b", "label_b")
    )
    divided = shared_group.filter("labels > 1").select(F.col("group").alias("group_a"))
    within = (
        left.join(divided, "group_a", "left_semi")
        .join(right.withColumn("group_a", F.col("group_b")), "group_a")
        .filter("label_a < label_b")
        .select("group_a", "label_a", "group_b", "label_b")
    )
    group_pairs = stored(across.union(retried).union(within).distinct(), "group-pairs")

    def classes_of(which: str) -> DataFrame:
        return labelled.select(
            F.col("group").alias(f"group_{which}"), F.col("label").alias(f"label_{which}"), F.col("class").alias(which)
        )

    pairs = group_pairs.join(classes_of("a"), ["group_a", "label_a"]).join(classes_of("b"), ["group_b", "label_b"])
    second_links = _linked(pairs.select("a", "b"), members, keyed, width, percent)
    labels = components(first_links.union(second_links))
    forget(entries, placed, hubs, stars, short_pairs, group_pairs, labelled, nodes)

    named_classes = stored(
        classes.select("class", "set_hi", "set_lo", "first_id")
        .join(labels.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("label", F.coalesce("label", "class")),
        "named-classes",
    )
    lowest = stored(named_classes.groupBy("label").agg(F.min("first_id").alias("component_id")), "lowest")
    found = stored(
        named_classes.join(lowest, "label").select("set_hi", "set_lo", "component_id"), "class-components"
    )
    shared.unpersist()
    return (
        profiles.select("piece_id", "n", "set_hi", "set_lo")
        .join(found, ["set_hi", "set_lo"], "left")
        .select(
            "piece_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("piece_id")).alias("component_id"),
        )
    )
