"""Components at every threshold from one structure: a maximum spanning forest by Boruvka's rounds, and its tree of levels.

An edge between two cells holds down to the smaller of their values. A maximum spanning forest keeps, of all edges, one fewer
than cells at most, and has the same components as all edges at every threshold; so it is built once and answers any
thresholds. In each round every component takes its strongest edge to another, components that meet are contracted by
stars, and edges inside a component go; components at least halve, so rounds are logarithmic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as C


def cell_edges(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, w) of the pairs (a, b) of cells (node, v): the smaller value; cells without a value have no edges."""
    v = cells.where("v is not null and not isnan(v)").select("node", "v")
    left, right = v.select(F.col("node").alias("a"), F.col("v").alias("va")), v.select(F.col("node").alias("b"), F.col("v").alias("vb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", F.least("va", "vb").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of a maximum spanning forest; of edges of one weight those of the smallest cells are taken."""
    a, b = F.least("a", "b").cast("long"), F.greatest("a", "b").cast("long")
    rest = edges.where("a <> b").groupBy(a.alias("a"), b.alias("b")).agg(F.max("w").alias("w"))
    rest = C.checkpointed(rest.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    parts = [rest.select("a", "b", "w").limit(0)]
    while not rest.isEmpty():
        edge = F.struct("w", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"), "ca", "cb")
        ends = rest.select(F.explode(F.array("ca", "cb")).alias("c"), edge.alias("e"))
        best = C.checkpointed(ends.groupBy("c").agg(F.max("e").alias("e")).select("e.*").distinct())
        parts.append(best.select((-F.col("na")).alias("a"), (-F.col("nb")).alias("b"), "w"))
        links = best.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        of = C.checkpointed(C.components(links.select(F.explode(F.array("a", "b")).alias("node")), links))
        for side in ("ca", "cb"):
            rest = rest.join(of.select(F.col("node").alias(side), F.col("component").alias(f"{side}_")), side).drop(side).withColumnRenamed(f"{side}_", side)
        # of the edges between two components the strongest is enough
        pair = [F.least("ca", "cb").alias("p"), F.greatest("ca", "cb").alias("q")]
        kept = rest.where("ca <> cb").groupBy(*pair).agg(F.max(edge).alias("e"))
        rest = C.checkpointed(kept.select((-F.col("e.na")).alias("a"), (-F.col("e.nb")).alias("b"), "e.w", "e.ca", "e.cb"))
    return reduce(DataFrame.unionByName, parts)


def components_at(cells: DataFrame, forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(level, node, component) of the cells with v >= the level's threshold; levels are numbered from 0 in ascending order.

    All levels at once: a cell and a level make one node, and an edge is in every level that its weight reaches."""
    steps = sorted(thresholds)
    reached = lambda v: F.explode(F.filter(F.array(*(F.struct(F.lit(i).cast("long").alias("level"), F.lit(float(t)).alias("least")) for i, t in enumerate(steps))), lambda s: v >= s["least"]))
    n = len(steps)
    nodes = cells.where("v is not null and not isnan(v)").select("node", reached(F.col("v")).alias("s")).select((F.col("node") * n + F.col("s.level")).alias("node"))
    links = forest.select("a", "b", reached(F.col("w")).alias("s")).select((F.col("a") * n + F.col("s.level")).alias("a"), (F.col("b") * n + F.col("s.level")).alias("b"))
    found = C.components(nodes, links)
    down = lambda c: F.floor(F.col(c) / n).cast("long")
    return found.select(F.pmod("node", F.lit(n)).cast("long").alias("level"), down("node").alias("node"), down("component").alias("component"))


def level_tree(cells: DataFrame, forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(level, threshold, component, area, peak, parent): every component with the one of the next lower level that holds it."""
    steps = sorted(thresholds)
    of = C.checkpointed(components_at(cells, forest, steps))
    size = of.join(cells.select("node", "v"), "node").groupBy("level", "component").agg(F.count("*").alias("area"), F.max("v").alias("peak"))
    below = of.select((F.col("level") + 1).alias("level"), F.col("node").alias("component"), F.col("component").alias("parent"))  # a component is one of its cells
    threshold = F.element_at(F.array(*(F.lit(float(t)) for t in steps)), (F.col("level") + 1).cast("int"))
    return size.join(below, ["level", "component"], "left").select("level", threshold.alias("threshold"), "component", "area", "peak", "parent")
