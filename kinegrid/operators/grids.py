"""Operators over cells of a grid: blocks, stencils, masks, components, scatter and nearest cells.

Neighbourhoods are joins on exploded offsets, so a stencil costs a shuffle by cell and never a pairing of cells.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_mean(rows: DataFrame, keys: list[str], x: str, y: str, size: int, values: list[str], width: int, height: int, whole_only: bool = False) -> DataFrame:
    """Mean over blocks of size x size cells; cells beyond the last whole block are left out, or, with whole_only, a width
    or height that the size does not divide raises."""
    if whole_only and (width % size or height % size):
        raise ValueError(f"{width} x {height} cells are no whole blocks of {size}")
    whole = rows.where((F.col(x) < width // size * size) & (F.col(y) < height // size * size))
    bx, by = F.floor(F.col(x) / size).cast("long"), F.floor(F.col(y) / size).cast("long")
    return whole.groupBy(*keys, bx.alias("bx"), by.alias("by")).agg(*(F.avg(F.when(~F.isnan(v), F.col(v))).alias(v) for v in values))


def offsets(radius: int, diagonal: bool = True) -> Column:
    """Array of (dx, dy) offsets within a square or, without diagonals, a diamond."""
    all_of = [(i, j) for i, j in product(range(-radius, radius + 1), repeat=2) if diagonal or abs(i) + abs(j) <= radius]
    return F.array(*(F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i, j in all_of))


def dilate(cells: DataFrame, keys: list[str], radius: int = 1, diagonal: bool = True) -> DataFrame:
    """Cells within reach of a set (keys, x, y)."""
    near = cells.select(*keys, "x", "y", F.explode(offsets(radius, diagonal)).alias("o"))
    return near.select(*keys, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()


def erode(cells: DataFrame, keys: list[str], radius: int = 1, diagonal: bool = True) -> DataFrame:
    """Cells of a set whose whole neighbourhood is in it."""
    n = (2 * radius + 1) ** 2 if diagonal else 2 * radius * (radius + 1) + 1
    near = cells.select(*keys, "x", "y", F.explode(offsets(radius, diagonal)).alias("o"))
    votes = near.groupBy(*keys, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).count()
    return votes.where(F.col("count") == n).drop("count")


def opening(cells: DataFrame, keys: list[str], radius: int = 1) -> DataFrame:
    return dilate(erode(cells, keys, radius), keys, radius)


def boundary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the dilated set that are not in the eroded one (four neighbours)."""
    return dilate(cells, keys, 1, False).exceptAll(erode(cells, keys, 1, False))


def cell_key(x, y):
    """One number for a cell, for coordinates of up to 31 bits."""
    return F.shiftleft(F.col(x).cast("long"), 32) + F.col(y).cast("long")


def neighbours(cells: DataFrame, node: str, keys: list[str], diagonal: bool = True) -> DataFrame:
    """(a, b): pairs of adjoining cells of a set by their numbers, each pair once."""
    near = cells.select(*keys, F.col(node).alias("a"), "x", "y", F.explode(offsets(1, diagonal)).alias("o"))
    near = near.select(*keys, "a", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return near.join(cells.withColumnRenamed(node, "b"), [*keys, "x", "y"]).where("a > b").select("a", "b")


def scatter_trilinear(points: DataFrame, keys: list[str], value: str, nx: int, ny: int, nz: int, eps: float = 1e-6) -> DataFrame:
    """Weighted mean of the points' values at the eight cells around each (px, py, pz); cells with hardly any weight are left out."""
    corner = F.explode(F.array(*(F.struct(*(F.lit(b).alias(n) for b, n in zip(c, ("i", "j", "k"), strict=True))) for c in product((0, 1), repeat=3))))
    base = points.select(*keys, value, "px", "py", "pz", *(F.floor(p).cast("long").alias(b) for p, b in (("px", "x0"), ("py", "y0"), ("pz", "z0"))), corner.alias("c"))
    w = F.lit(1.0)
    for p, b, c in (("px", "x0", "i"), ("py", "y0", "j"), ("pz", "z0", "k")):
        f = F.col(p) - F.col(b)
        w = w * F.when(F.col(f"c.{c}") == 1, f).otherwise(1 - f)
    at = base.select(*keys, value, w.alias("w"), *((F.col(b) + F.col(f"c.{c}")).alias(o) for b, c, o in (("x0", "i", "x"), ("y0", "j", "y"), ("z0", "k", "z"))))
    at = at.where(f"x >= 0 and x < {nx} and y >= 0 and y < {ny} and z >= 0 and z < {nz}")
    return at.groupBy(*keys, "x", "y", "z").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(value)).alias("s")).where(F.col("w") > eps).select(*keys, "x", "y", "z", "w", (F.col("s") / F.col("w")).alias("v"))


def splat_max(points: DataFrame, planes: list[float], window: float, value: str, nx: int, ny: int) -> DataFrame:
    """Largest value by plane and pixel of the points within the window of the plane, over the four pixels around each."""
    near = points.select("px", "py", value, F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("plane"), F.lit(z).alias("z0")) for i, z in enumerate(planes))), lambda s: F.abs(F.col("pz") - s["z0"]) <= window)).alias("p"))
    x = F.explode(F.array_distinct(F.array(F.floor("px"), F.ceil("px"))))
    near = near.select(F.col("p.plane").alias("plane"), "py", value, x.alias("x"))
    near = near.select("plane", value, "x", F.explode(F.array_distinct(F.array(F.floor("py"), F.ceil("py")))).alias("y"))
    return near.where(f"x >= 0 and x < {nx} and y >= 0 and y < {ny}").groupBy("plane", "x", "y").agg(F.max(value).alias("v"))


def fill_holes(cells: DataFrame, keys: list[str], value: str, reach: int) -> DataFrame:
    """Null cells get the value of the nearest filled one within reach (ties: smallest dx, then dy)."""
    disc = [(i, j) for i, j in product(range(-reach, reach + 1), repeat=2) if 0 < i * i + j * j <= reach * reach]
    o = F.explode(F.array(*(F.struct(F.lit(i * i + j * j).alias("d"), F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i, j in disc)))
    holes = cells.where(F.col(value).isNull()).select(*keys, "x", "y", o.alias("o"))
    near = holes.select(*keys, F.col("x").alias("hx"), F.col("y").alias("hy"), "o", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    full = cells.where(F.col(value).isNotNull())
    best = near.join(full, [*keys, "x", "y"]).groupBy(*keys, F.col("hx").alias("x"), F.col("hy").alias("y")).agg(F.min_by(value, "o").alias("_kg_near"))
    return cells.join(best, [*keys, "x", "y"], "left").select(*keys, "x", "y", F.coalesce(value, "_kg_near").alias(value), F.col(value).isNull().alias("was_hole"))


def weighted_stats(rows: DataFrame, keys: list[str], w: str) -> DataFrame:
    """Strength, effective area, centroid and covariance of weights over cells, from one pass of moments."""
    m = rows.groupBy(*keys).agg(
        F.sum(w).alias("s"), F.sum(F.col(w) * F.col(w)).alias("s2"), F.sum(F.col(w) * F.col("x")).alias("sx"), F.sum(F.col(w) * F.col("y")).alias("sy"),
        F.sum(F.col(w) * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col(w) * F.col("y") * F.col("y")).alias("syy"), F.sum(F.col(w) * F.col("x") * F.col("y")).alias("sxy"),
    ).where("s > 0")
    cx, cy = F.col("sx") / F.col("s"), F.col("sy") / F.col("s")
    return m.select(*keys, F.col("s").alias("strength"), (F.col("s") * F.col("s") / F.col("s2")).alias("area_eff"), cx.alias("cx"), cy.alias("cy"), (F.col("sxx") / F.col("s") - cx * cx).alias("vxx"), (F.col("syy") / F.col("s") - cy * cy).alias("vyy"), (F.col("sxy") / F.col("s") - cx * cy).alias("vxy"))


def pair_overlap(cells: DataFrame, region: str) -> DataFrame:
    """(i, j, inter, a, b, iou) of regions that share a cell; regions meet by cell, so none is paired in vain."""
    size = cells.groupBy(region).agg(F.count("*").alias("n"))
    left, right = cells.select(F.col(region).alias("i"), "x", "y"), cells.select(F.col(region).alias("j"), "x", "y")
    inter = left.join(right, ["x", "y"]).where("i < j").groupBy("i", "j").agg(F.count("*").alias("inter"))
    inter = inter.join(size.select(F.col(region).alias("i"), F.col("n").alias("a")), "i").join(size.select(F.col(region).alias("j"), F.col("n").alias("b")), "j")
    return inter.select("i", "j", "inter", "a", "b", (F.col("inter") / (F.col("a") + F.col("b") - F.col("inter"))).alias("iou"))


def near_pairs(points: DataFrame, node: str, reach: float) -> DataFrame:
    """(i, j, distance) of points (node, cx, cy) at most ``reach`` apart, i < j: they meet in buckets of that size, of
    which each point enters the nine around its own, so no pair is lost and none meets twice."""
    bx, by = F.floor(F.col("cx") / reach).cast("long"), F.floor(F.col("cy") / reach).cast("long")
    left = points.select(F.col(node).alias("i"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), bx.alias("bx"), by.alias("by"), F.explode(offsets(1)).alias("o"))
    left = left.select("i", "ix", "iy", (F.col("bx") + F.col("o.dx")).alias("bx"), (F.col("by") + F.col("o.dy")).alias("by"))
    right = points.select(F.col(node).alias("j"), F.col("cx").alias("jx"), F.col("cy").alias("jy"), bx.alias("bx"), by.alias("by"))
    d = F.sqrt((F.col("ix") - F.col("jx")) * (F.col("ix") - F.col("jx")) + (F.col("iy") - F.col("jy")) * (F.col("iy") - F.col("jy")))
    return left.join(right, ["bx", "by"]).where("i < j").select("i", "j", d.alias("distance")).where(F.col("distance") <= reach)


def best(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_kg_k", F.row_number().over(w)).where("_kg_k = 1").drop("_kg_k")
