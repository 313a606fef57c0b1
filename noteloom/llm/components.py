"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.columns import forget, stored


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``links`` (a, b: long).

    Returns ``node`` and ``label`` for every node that has a link. In a round each node points to its
    smallest neighbour, pointers are followed twice, and the links are redrawn
    between what they point to; links inside one label go. Rounds are stored, so
    a lost executor costs one round, and no node's neighbours are ever gathered.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.filter("a <> b").distinct(), "edges")
    labels = stored(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        lower = edges.groupBy("a").agg(F.min("b").alias("b"))
        lower = stored(lower.select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "pointers")
        for _ in range(2):
            above = lower.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            jumped = lower.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"))
            jumped, old = stored(jumped, "pointers"), lower
            forget(old)
            lower = jumped
        found = labels.join(lower.withColumnRenamed("node", "label"), "label", "left")
        found = stored(found.select("node", F.coalesce("up", "label").alias("label")), "labels")
        ends = lower.select(F.col("node").alias("b"), F.col("up").alias("to_b"))
        redrawn = edges.join(lower.withColumnRenamed("node", "a"), "a").join(ends, "b")
        redrawn = stored(
            redrawn.select(F.col("up").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct(), "edges"
        )
        forget(labels, edges, lower)
        labels, edges = found, redrawn
    return labels
