"""Complete linkage over a component of any size, by rounds of reciprocal nearest neighbours.

Pairs are ordered by distance, then by the names of their clusters (smallest members), lowest first. In a round every
cluster looks for its first pair, and two that have found each other merge; a pair of new clusters has the largest of the
distances between their parts, and none if one of them is unknown or beyond the cut. A merge never brings a pair
before both that it comes from, so all the round's merges are among those of the one-by-one procedure, ties included.
The rounds are aggregates and joins over the pairs that are left; no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed


def complete_linkage(nodes: DataFrame, distances: DataFrame, cut: float) -> DataFrame:
    """(node, cluster): clusters of the nodes from the distances (i, j, d) that are known, cut at a height and named by
    their smallest node. Pairs that are not given never join; of a pair given twice the larger distance counts."""
    known = distances.where(F.col("i").isNotNull() & F.col("j").isNotNull() & (F.col("i") != F.col("j")) & F.col("d").isNotNull() & ~F.isnan("d"))
    low, high = F.least("i", "j").cast("long"), F.greatest("i", "j").cast("long")
    pairs = known.groupBy(low.alias("a"), high.alias("b")).agg(F.max("d").cast("double").alias("d")).where(F.col("d") <= cut)
    pairs = checkpointed(pairs)
    names = checkpointed(nodes.select(F.col("node").cast("long").alias("node")).distinct().withColumn("cluster", F.col("node")))
    while True:
        first = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.struct("d", "a", "b").alias("p")).groupBy("c").agg(F.min("p").alias("p"))
        merges = checkpointed(first.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.a", "p.b"))
        if merges.isEmpty():  # there is a first pair of all as long as there are pairs
            break
        into = merges.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"))
        moved = pairs
        for side in ("a", "b"):
            to = into.select(F.col("old").alias(side), F.col("new").alias(f"{side}_new"))
            moved = moved.join(to, side, "left").withColumn(f"{side}_parts", F.when(F.col(f"{side}_new").isNull(), 1).otherwise(2)).withColumn(side, F.coalesce(f"{side}_new", side)).drop(f"{side}_new")
        between = moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max(F.col("a_parts") * F.col("b_parts")).alias("parts"))
        pairs = checkpointed(between.where("n = parts").select("a", "b", "d"))
        renamed = merges.select(F.col("b").alias("cluster"), F.col("a").alias("new"))
        names = checkpointed(names.join(renamed, "cluster", "left").select("node", F.coalesce("new", "cluster").alias("cluster")))
    return names
