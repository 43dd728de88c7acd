"""Connected components of an edge table by alternating star contractions; rounds go to the checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 200_000  # links that one task contracts at once
MANY, SMALL = 1000, 10_000  # a node with a MANYth of the links is hot, if there are more than SMALL


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the cluster's checkpoint folder (a private one only in local mode without the setting)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="kinegrid-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def contract(links: DataFrame, store: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is named by its smallest node.

    Large star and small star steps alternate until each node points straight at its component's smallest
    node, in O(log^2 n) rounds. A step is an aggregate and a join; ``store`` keeps a round's table. Links of a node to itself add a component of its own; nulls link nothing.
    """
    a, b = F.col("a"), F.col("b")
    links = links.where("a is not null and b is not null").select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct()
    edges = store(links, 0)
    for turn in range(1, 200):
        loose = edges.where("a <> b")
        ends = loose.select(a.alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(loose.select(b.alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        degree = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        forks, chains, most, total = degree.agg(F.max("up"), F.max(F.least("up", "down")), F.max(F.col("up") + F.col("down")), F.sum("up")).first()
        if not total or forks == 1 and not chains:
            break
        both = loose.select("a", "b").unionByName(loose.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        above = both.where("b > a")
        if most * MANY > total > SMALL:
            # nodes with more than a thousandth of all links, two thousand at most, meet theirs by a broadcast
            hot = F.broadcast(least.where(F.col("n") * MANY > total).drop("n"))
            above = above.join(hot, "a").unionByName(above.join(hot.select("a"), "a", "left_anti").join(least.drop("n"), "a"))
        else:
            above = above.join(least.drop("n"), "a")
        large = above.select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        lone = edges.where("a = b")
        edges = store(small.unionByName(lone).distinct(), turn)
    else:
        raise RuntimeError("components did not settle")
    pointing = edges.where("a <> b")
    return pointing.select(a.alias("node"), b.alias("component")).unionByName(edges.select(b.alias("node"), b.alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded number of links in one task."""
    parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], names=["node", "component"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): each node with the smallest node that it can reach over edges (a, b).

    Up to FEW links, counted first, go to one task; more are contracted by stars."""
    own = nodes.select(F.col("node").cast("long").alias("node")).distinct()
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    links = checkpointed(links)
    if links.limit(FEW + 1).count() <= FEW:
        found = links.coalesce(1).mapInArrow(_at_once, "node long, component long")
    else:
        found = contract(links, lambda df, _: checkpointed(df))
    return own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
