"""Episodes of a grid: groups of units of one span, chained where spans and masks agree, and the rules that drop artifacts.

Units with the same first and last frame are a group, and the cells of its units are its mask. Two groups belong
together where both ends of their spans are within a tolerance and the earlier one's mask, dilated, covers more than a part
of the smaller mask. Spans meet by exploded tolerances, masks by cell: no two groups are compared cell by cell that
don't share a time bucket and whose boxes are out of reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components as C
from . import grids as G
from . import ranks as R


def groups(units: DataFrame) -> DataFrame:
    """(node, t0, t1, n, box): units (x, y, t0, t1) by span; node numbers a span."""
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    return units.groupBy("t0", "t1").agg(F.count("*").alias("n"), *box).withColumn("node", span_key("t0", "t1"))


def span_key(t0: str, t1: str) -> Column:
    return F.shiftleft(F.col(t0).cast("long"), 32) + F.col(t1).cast("long")


def links(units: DataFrame, tolerance: int = 1, reach: int = 3, overlap: float = 0.3, least: int = 1) -> DataFrame:
    """(a, b, shared): groups of at least ``least`` units that belong together, a before b; shared: the part of the smaller mask."""
    g = groups(units).where(F.col("n") >= least)
    near = F.array(*(F.lit(k).cast("long") for k in range(-tolerance, tolerance + 1)))
    own = [F.col(c).alias(f"a_{c}") for c in ("node", "n", "x0", "x1", "y0", "y1")]
    spread = g.select(*own, "t0", "t1", F.explode(near).alias("d0")).select(*(c for c in [f"a_{k}" for k in ("node", "n", "x0", "x1", "y0", "y1")]), (F.col("t0") + F.col("d0")).alias("t0"), "t1", F.explode(near).alias("d1"))
    spread = spread.withColumn("t1", F.col("t1") + F.col("d1")).drop("d1")
    boxes = (F.col("a_x1") + reach >= F.col("x0")) & (F.col("x1") + reach >= F.col("a_x0")) & (F.col("a_y1") + reach >= F.col("y0")) & (F.col("y1") + reach >= F.col("a_y0"))
    pairs = spread.join(g, ["t0", "t1"]).where((F.col("a_node") < F.col("node")) & boxes).select(F.col("a_node").alias("a"), F.col("node").alias("b"), F.least("a_n", "n").alias("smaller"))
    pairs = C.checkpointed(pairs)
    cells = units.select(span_key("t0", "t1").alias("node"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    sizes = cells.groupBy("node").agg(F.count("*").alias("size"))
    first = cells.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    wide = G.dilate(first, ["node"], reach, diagonal=False).withColumnRenamed("node", "a")
    shared = pairs.select("a", "b").join(wide, "a").join(cells.withColumnRenamed("node", "b"), ["b", "x", "y"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    for side in ("a", "b"):
        shared = shared.join(sizes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}")), side)
    part = F.col("shared") / F.least("size_a", "size_b")
    return shared.select("a", "b", part.alias("shared")).where(F.col("shared") > overlap)


def members(units: DataFrame, tolerance: int = 1, reach: int = 3, overlap: float = 0.3, least: int = 1) -> DataFrame:
    """(node, episode) of every group; an episode is named by its first group."""
    found = C.components(groups(units).select("node"), links(units, tolerance, reach, overlap, least))
    return found.withColumnRenamed("component", "episode")


def summary(units: DataFrame, of: DataFrame, least: int) -> DataFrame:
    """(episode, t0, t1, area, cells, groups): units and different cells of each episode that has ``least`` cells."""
    node = span_key("t0", "t1")
    rows = units.withColumn("node", node).join(of, "node")
    out = rows.groupBy("episode").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("area"), F.countDistinct(G.cell_key("x", "y")).alias("cells"), F.countDistinct("node").alias("groups"))
    return out.where(F.col("cells") >= least)


def edge_cells(valid: DataFrame, width: int) -> DataFrame:
    """Cells (x, y) of a mask that lie within ``width`` of a place outside it."""
    disc = [(i, j) for i in range(-width, width + 1) for j in range(-width, width + 1) if i * i + j * j <= width * width]
    near = F.array(*(F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i, j in disc))
    votes = valid.select("x", "y", F.explode(near).alias("o")).groupBy((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).agg(F.count("*").alias("c"))
    return valid.join(votes.where(F.col("c") < len(disc)), ["x", "y"], "left_semi")


def global_correlation(cells: DataFrame, motion: DataFrame) -> DataFrame:
    """(episode, corr): correlation, over the episode's frames, of its cells' mean motion with the median of all cells'.

    cells: (episode, x, y, t0, t1), each cell once; motion: (x, y, t, v). Flat series correlate with nothing (0)."""
    whole = R.group_quantiles(motion, ["t"], "v", {"whole": 0.5}).drop("n")
    mean = motion.join(cells, ["x", "y"]).where("t >= t0 and t <= t1").groupBy("episode", "t").agg(F.avg("v").alias("own"))
    both = mean.join(whole, "t").groupBy("episode").agg(F.covar_pop("own", "whole").alias("c"), F.var_pop("own").alias("a"), F.var_pop("whole").alias("b"))
    return both.select("episode", F.when((F.col("a") > 1e-12) & (F.col("b") > 1e-12), F.col("c") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0).alias("corr"))


def artifacts(units: DataFrame, of: DataFrame, motion: DataFrame, least: int, most_part: float = 0.5, shortest: int = 3, longest: int | None = None, most_corr: float | None = 0.9, most_edge: float | None = 0.8, edge: int = 3) -> DataFrame:
    """(episode, t0, t1, area, cells, corr, edge, reason): every episode with the first rule that drops it, or ``kept``.

    In this order: more than a part of all cells; too short; too long; moving as the whole; at the border of the cells."""
    e = summary(units, of, least)
    # an episode's span is its own, not the unit's: cells take it over
    own = units.withColumn("node", span_key("t0", "t1")).join(of, "node").select("episode", "x", "y").distinct().join(e.select("episode", "t0", "t1"), "episode")
    own = C.checkpointed(own)
    valid = motion.select("x", "y").distinct()
    corr = global_correlation(own, motion)
    border = own.join(edge_cells(valid, edge), ["x", "y"], "left_semi").groupBy("episode").agg(F.count("*").alias("at_edge"))
    total = valid.agg(F.count("*").alias("valid"))  # one row
    rows = e.join(corr, "episode", "left").join(border, "episode", "left").join(F.broadcast(total))
    part, frames = F.coalesce("at_edge", F.lit(0)) / F.col("cells"), F.col("t1") - F.col("t0") + 1
    reason = F.when(F.col("cells") > most_part * F.col("valid"), "fov").when(frames < shortest, "short")
    if longest is not None:
        reason = reason.when(frames > longest, "long")
    if most_corr is not None:
        reason = reason.when(F.coalesce("corr", F.lit(0.0)) > most_corr, "global")
    if most_edge is not None:
        reason = reason.when(part > most_edge, "edge")
    return rows.select("episode", "t0", "t1", "area", "cells", F.coalesce("corr", F.lit(0.0)).alias("corr"), part.alias("edge"), reason.otherwise("kept").alias("reason"))
