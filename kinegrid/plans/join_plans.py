"""Queries of tolerance, overlap, nearest, interval and set joins, of top-k rules and of components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import components as C
from ..operators import episodes as E
from ..operators import grids as G
from ..operators import kernels as K
from ..operators import ranks as R
from . import inputs as I
from .registry import register
from .window_plans import UNITS, units

ACTIVE = "act AS (SELECT site AS region, t AS x, site // 15 AS y FROM patches WHERE v > 300)"


def reference_frames(spark, sf_dir):
    """(frame, file): closed intervals from names, a row for each frame that a reference covers."""
    names = I.table(spark, sf_dir, "part").select(F.format_string("vol_ref_%06d_%06d.tif", "p_partkey", F.col("p_partkey") + F.col("p_size")).alias("file"))
    m = lambda i: F.regexp_extract("file", r"vol_ref_(\d{6,})_(\d{6,})\.tif", i).cast("long")
    return names.select("file", F.explode(F.sequence(m(1), m(2))).alias("frame"))


def order_frames(spark, sf_dir):
    """Orders with their frame: order keys fold onto the part keys' range."""
    last = I.table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("last"))  # one row
    return I.table(spark, sf_dir, "orders").join(F.broadcast(last)).withColumn("frame", F.col("o_orderkey") % F.col("last"))


def reference_intervals(spark, sf_dir):
    """Frames with the references that cover them, joined by equality. Part keys begin intervals and order keys fold onto
    their range, so a frame has about as many references at any size.

    The planner takes an exploded table to be as small as the one it comes from, so the join is told not to broadcast it."""
    o = order_frames(spark, sf_dir).select("o_orderkey", "frame")
    return o.join(reference_frames(spark, sf_dir).hint("merge"), "frame").select("o_orderkey", "frame", "file")


register("reference_intervals", reference_intervals, r"""
WITH f AS (SELECT printf('vol_ref_%06d_%06d.tif', p_partkey, p_partkey + p_size) AS file, p_partkey AS a, p_partkey + p_size AS b FROM part), o AS (SELECT o_orderkey, o_orderkey % (SELECT max(p_partkey) FROM part) AS frame FROM orders)
SELECT o_orderkey, frame, file FROM o JOIN f ON frame BETWEEN a AND b""")


def tolerance_pairs(spark, sf_dir):
    """Pairs of unit groups whose start and end both lie within one frame, by equality on exploded tolerances."""
    g = units(spark, sf_dir).groupBy("t0", "t1").agg(F.count("*").alias("n"))
    d = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    near = g.select(F.col("t0").alias("a0"), F.col("t1").alias("a1"), F.col("n").alias("na"), F.explode(d).alias("d0")).select("a0", "a1", "na", (F.col("a0") + F.col("d0")).alias("t0"), F.explode(d).alias("d1"))
    near = near.select("a0", "a1", "na", "t0", (F.col("a1") + F.col("d1")).alias("t1"))
    return near.join(g, ["t0", "t1"]).where("(a0 < t0) or (a0 = t0 and a1 < t1)").select("a0", "a1", F.col("t0").alias("b0"), F.col("t1").alias("b1"), "na", F.col("n").alias("nb"))


register("tolerance_pairs", tolerance_pairs, f"""
WITH {I.PATCHES}, {UNITS}, g AS (SELECT t0, t1, count(*) AS n FROM units GROUP BY t0, t1)
SELECT a.t0 AS a0, a.t1 AS a1, b.t0 AS b0, b.t1 AS b1, a.n AS na, b.n AS nb FROM g a JOIN g b ON abs(a.t0 - b.t0) <= 1 AND abs(a.t1 - b.t1) <= 1 AND (a.t0 < b.t0 OR a.t0 = b.t0 AND a.t1 < b.t1)""")


def placed(spark, sf_dir):
    """(site, x, y, t0, t1): units with their cells."""
    return units(spark, sf_dir).select("site", (F.col("site") % I.WIDTH).cast("long").alias("x"), F.floor(F.col("site") / I.WIDTH).alias("y"), "t0", "t1")


def motion_episodes(spark, sf_dir):
    """Episodes: unit groups chained where their spans are close and their masks overlap, with bounds, units and cells."""
    u = placed(spark, sf_dir)
    return E.summary(u, E.members(u, reach=REACH, least=LEAST), LEAST)


LEAST, REACH = 3, 1  # units of a group that can be chained and cells of an episode; dilation, on a grid 15 cells wide
EPISODES = f"""
{I.PATCHES}, {UNITS}, placed AS (SELECT site, site % 15 AS x, site // 15 AS y, t0, t1, t0 * 4294967296 + t1 AS node FROM units),
g AS (SELECT node, t0, t1, count(*) AS n FROM placed GROUP BY ALL),
diamond AS (SELECT a.i, b.i AS j FROM (SELECT unnest(range(-{REACH}, {REACH + 1})) AS i) a, (SELECT unnest(range(-{REACH}, {REACH + 1})) AS i) b WHERE abs(a.i) + abs(b.i) <= {REACH}),
wide AS (SELECT DISTINCT node, x + i AS x, y + j AS y FROM placed, diamond),
near AS (SELECT a.node AS a, b.node AS b, least(a.n, b.n) AS smaller FROM g a JOIN g b ON abs(a.t0 - b.t0) <= 1 AND abs(a.t1 - b.t1) <= 1 AND a.node < b.node WHERE a.n >= {LEAST} AND b.n >= {LEAST}),
linked AS (SELECT a, b FROM near JOIN wide w ON w.node = a JOIN placed p ON p.node = b AND p.x = w.x AND p.y = w.y GROUP BY a, b HAVING count(*) / min(smaller) > 0.3),
e AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
r AS (SELECT node AS a, node AS b FROM g UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
members AS (SELECT a AS node, min(b) AS episode FROM r GROUP BY a),
episodes AS (SELECT episode, min(t0) AS t0, max(t1) AS t1, count(*) AS area, count(DISTINCT (x, y)) AS cells, count(DISTINCT node) AS groups FROM placed JOIN members USING (node) GROUP BY episode HAVING count(DISTINCT (x, y)) >= {LEAST})"""
register("motion_episodes", motion_episodes, f"WITH RECURSIVE {EPISODES} SELECT * FROM episodes")


def active_cells(spark, sf_dir):
    """(region, x, y): active days of each site in its row of the grid; a cell is shared by a row's sites at most."""
    return I.patches(spark, sf_dir).where("v > 300").select(F.col("site").alias("region"), F.col("t").cast("long").alias("x"), F.floor(F.col("site") / I.WIDTH).alias("y"))


def region_overlap(spark, sf_dir):
    return G.pair_overlap(active_cells(spark, sf_dir), "region").select("i", "j", "inter", "a", "b", S.r6(F.col("iou")).alias("iou"))


PAIRS = """
sz AS (SELECT region, count(*) AS n FROM act GROUP BY region),
pr AS (SELECT p.region AS i, q.region AS j, count(*) AS inter FROM act p JOIN act q ON p.x = q.x AND p.y = q.y AND p.region < q.region GROUP BY ALL),
pairs AS (SELECT i, j, inter, s.n AS a, u.n AS b, inter / (s.n + u.n - inter) AS iou FROM pr JOIN sz s ON s.region = i JOIN sz u ON u.region = j)"""
register("region_overlap", region_overlap, f"WITH {I.PATCHES}, {ACTIVE}, {PAIRS} SELECT i, j, inter, a, b, round(iou, 6) AS iou FROM pairs")


def compatible_regions(spark, sf_dir):
    """Pairs of different groups that overlap enough or whose centroids are near, with the rule that let them in.

    Overlapping pairs meet by cell, near ones by buckets of their centroids, whether or not they share a cell."""
    cells = active_cells(spark, sf_dir)
    c = cells.groupBy("region").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    near = G.near_pairs(c, "region", 1.0).select("i", "j")
    both = G.pair_overlap(cells, "region").select("i", "j", "iou").join(near.withColumn("near", F.lit(True)), ["i", "j"], "full").where("i % 3 <> j % 3")
    j = both.join(c.select(F.col("region").alias("i"), F.col("cx").alias("ix"), F.col("cy").alias("iy")), "i").join(c.select(F.col("region").alias("j"), F.col("cx").alias("jx"), F.col("cy").alias("jy")), "j")
    iou, d = F.coalesce("iou", F.lit(0.0)), S.norm(F.col("ix") - F.col("jx"), F.col("iy") - F.col("jy"))
    return j.select("i", "j", S.r6(iou).alias("iou"), S.r6(d).alias("distance"), F.when(iou >= 0.3, "iou").when(F.col("near"), "centroid").otherwise("none").alias("reason"))


register("compatible_regions", compatible_regions, f"""
WITH {I.PATCHES}, {ACTIVE}, {PAIRS}, c AS (SELECT region, avg(x) AS cx, avg(y) AS cy FROM act GROUP BY region),
d AS (SELECT p.region AS i, q.region AS j, sqrt((p.cx-q.cx)*(p.cx-q.cx) + (p.cy-q.cy)*(p.cy-q.cy)) AS distance FROM c p JOIN c q ON p.region < q.region WHERE p.region % 3 <> q.region % 3)
SELECT d.i, d.j, round(coalesce(iou, 0.0), 6) AS iou, round(distance, 6) AS distance, CASE WHEN iou >= 0.3 THEN 'iou' WHEN distance <= 1.0 THEN 'centroid' ELSE 'none' END AS reason
FROM d LEFT JOIN pairs ON pairs.i = d.i AND pairs.j = d.j WHERE iou IS NOT NULL OR distance <= 1.0""")


def grid_size(spark, sf_dir):
    """One row: the grid's rows and the frames."""
    return I.table(spark, sf_dir, "events").agg(F.countDistinct(F.floor(F.col("user_id") / I.WIDTH)).alias("rows"), (F.max(F.datediff(F.to_date("ts"), F.lit(I.EPOCH))) + 1).alias("frames"))


GRID = "grid AS (SELECT count(DISTINCT user_id // 15) AS rows, max(t) + 1 AS frames FROM ev)"


def overlapping_patterns(spark, sf_dir):
    """Regions against a query mask, frames 5 to 14 of all rows: kept if any of three coverages passes; best overlap first."""
    cells = active_cells(spark, sf_dir)
    hit = ((F.col("x") >= 5) & (F.col("x") < 15)).cast("int")
    r = cells.groupBy("region").agg(F.sum(hit).alias("inter"), F.count("*").alias("n")).where("inter > 0").join(F.broadcast(grid_size(spark, sf_dir)))
    q = F.col("rows") * 10.0
    rows = r.select("region", "inter", S.r6(F.col("inter") / (F.col("n") + q - F.col("inter"))).alias("iou"), S.r6(F.col("inter") / q).alias("query_covered"), S.r6(F.col("inter") / F.col("n")).alias("pattern_covered"))
    return rows.where("iou >= 0.05 or query_covered >= 0.1 or pattern_covered >= 0.5").orderBy(F.desc("iou"), "region")


register("overlapping_patterns", overlapping_patterns, f"""
WITH {I.PATCHES}, {ACTIVE}, {GRID}, r AS (SELECT region, count(*) FILTER (x >= 5 AND x < 15) AS inter, count(*) AS n FROM act GROUP BY region),
o AS (SELECT region, inter, round(inter / (n + rows * 10.0 - inter), 6) AS iou, round(inter / (rows * 10.0), 6) AS query_covered, round(inter / n, 6) AS pattern_covered FROM r, grid WHERE inter > 0)
SELECT * FROM o WHERE iou >= 0.05 OR query_covered >= 0.1 OR pattern_covered >= 0.5""")


def roi_classes(spark, sf_dir):
    """Units by how much of them, and of the region of interest, the two share."""
    cells = active_cells(spark, sf_dir)
    inside = (F.col("x") < 10).cast("int")
    r = cells.groupBy("region").agg(F.sum(inside).alias("inter"), F.count("*").alias("n")).join(F.broadcast(grid_size(spark, sf_dir)))
    loc, glob = F.col("inter") / F.col("n"), F.col("n") / F.col("frames")
    cls = F.when(F.col("inter") < 1, "outside").when(loc >= 0.6, "local").when(glob >= 0.2, "global").otherwise("mixed")
    return r.select("region", "inter", S.r6(loc).alias("locality"), S.r6(glob).alias("globalness"), cls.alias("class"))


register("roi_classes", roi_classes, f"""
WITH {I.PATCHES}, {ACTIVE}, {GRID}, r AS (SELECT region, count(*) FILTER (x < 10) AS inter, count(*) AS n FROM act GROUP BY region)
SELECT region, inter, round(inter / n, 6) AS locality, round(n / frames, 6) AS globalness,
  CASE WHEN inter < 1 THEN 'outside' WHEN inter / n >= 0.6 THEN 'local' WHEN n / frames >= 0.2 THEN 'global' ELSE 'mixed' END AS class FROM r, grid""")


def class_intervals(spark, sf_dir):
    from ..operators.windows import union_intervals

    u = units(spark, sf_dir).join(roi_classes(spark, sf_dir).select(F.col("region").alias("site"), "class"), "site").where("class in ('local', 'mixed')")
    return union_intervals(u, ["class"], "t0", "t1", 1).select("class", "t0", "t1", "n")


register("class_intervals", class_intervals, f"""
WITH {I.PATCHES}, {UNITS}, {ACTIVE}, {GRID}, r AS (SELECT region, count(*) FILTER (x < 10) AS inter, count(*) AS n FROM act GROUP BY region),
k AS (SELECT region, CASE WHEN inter < 1 THEN 'outside' WHEN inter / n >= 0.6 THEN 'local' WHEN n / frames >= 0.2 THEN 'global' ELSE 'mixed' END AS class FROM r, grid),
i AS (SELECT class, t0, t1 FROM units JOIN k ON region = site WHERE class IN ('local', 'mixed')),
f AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY class ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS fresh FROM i),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY class ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT class, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM s GROUP BY class, run""")


def nearest_blobs(spark, sf_dir):
    """Nearest blob of the other set within a radius, by buckets of the radius' size: recall and mean distance by frame."""
    p = I.field(spark, sf_dir)
    a, b = p.where("dx > 45").select("t", "x", "y"), p.where("dy > 9").select("t", F.col("x").alias("qx"), F.col("y").alias("qy"))
    three = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    near = a.select("t", "x", "y", F.explode(three).alias("i")).select("t", "x", "y", (F.floor(F.col("x") / 5) + F.col("i")).alias("bx"), F.explode(three).alias("j"))
    near = near.select("t", "x", "y", "bx", (F.floor(F.col("y") / 5) + F.col("j")).alias("b_y"))
    b = b.withColumn("bx", F.floor(F.col("qx") / 5)).withColumn("b_y", F.floor(F.col("qy") / 5))
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    best = near.join(b, ["t", "bx", "b_y"]).withColumn("d2", d2).where("d2 <= 25").groupBy("t", "x", "y").agg(F.min("d2").alias("d2"))
    out = a.join(best, ["t", "x", "y"], "left")
    return out.groupBy("t").agg(F.count("*").alias("blobs"), F.count("d2").alias("matched"), S.r6(F.avg(F.sqrt("d2"))).alias("mean_distance"))


register("nearest_blobs", nearest_blobs, f"""
WITH {I.FIELD}, a AS (SELECT t, x, y FROM field WHERE dx > 45), b AS (SELECT t, x AS qx, y AS qy FROM field WHERE dy > 9),
d AS (SELECT a.t, a.x, a.y, min((x-qx)*(x-qx) + (y-qy)*(y-qy)) AS d2 FROM a JOIN b ON a.t = b.t AND (x-qx)*(x-qx) + (y-qy)*(y-qy) <= 25 GROUP BY ALL)
SELECT a.t, count(*) AS blobs, count(d2) AS matched, round(avg(sqrt(d2)), 6) AS mean_distance FROM a LEFT JOIN d ON a.t = d.t AND a.x = d.x AND a.y = d.y GROUP BY a.t""")


def holes_filled(spark, sf_dir):
    """Every month's holes from their nearest filled cell within two cells; what stays open is classified."""
    f = I.field(spark, sf_dir)
    grid = f.select("t").distinct().select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("x")).select("t", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("y"))
    cells = grid.join(f.select("t", "x", "y", "dx"), ["t", "x", "y"], "left")
    out = G.fill_holes(cells, ["t"], "dx", 2)
    return out.select("t", "x", "y", S.r6(F.col("dx")).alias("dx"), F.when(~F.col("was_hole"), "sample").when(F.col("dx").isNotNull(), "gap").otherwise("no_coverage").alias("kind"))


register("holes_filled", holes_filled, f"""
WITH {I.FIELD}, g AS (SELECT t, x, y FROM (SELECT DISTINCT t FROM field), (SELECT unnest(range(0, 40)) AS x), (SELECT unnest(range(0, 25)) AS y)), m AS (SELECT t, x, y, dx FROM field),
o AS (SELECT a.i, b.i AS j FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS i) b WHERE a.i * a.i + b.i * b.i <= 4),
n AS (SELECT g.t, g.x, g.y, arg_min(m.dx, (i * i + j * j, i, j)) AS near FROM g JOIN o ON true JOIN m ON m.t = g.t AND m.x = g.x + i AND m.y = g.y + j GROUP BY ALL)
SELECT g.t, g.x, g.y, round(coalesce(m.dx, near), 6) AS dx, CASE WHEN m.dx IS NOT NULL THEN 'sample' WHEN near IS NOT NULL THEN 'gap' ELSE 'no_coverage' END AS kind FROM g LEFT JOIN m USING (t, x, y) LEFT JOIN n USING (t, x, y)""")


def quantile_mapped(spark, sf_dir):
    """Piecewise linear map between quantile anchors of two distributions, flat outside, applied to every price. The
    eleven anchors of each are exact order statistics, found by counting in narrowing brackets."""
    li, o = I.table(spark, sf_dir, "lineitem"), I.table(spark, sf_dir, "orders")
    q = [i / 10 for i in range(11)]
    s, g = (F.array(*map(F.lit, R.quantiles(t, c, q))) for t, c in ((li, "l_extendedprice"), (o, "o_totalprice")))
    v = F.col("l_extendedprice")
    k = F.greatest(F.lit(0), F.least(F.lit(9), F.size(F.filter(s, lambda a: a <= v)) - 1))
    lo, hi = F.get(s, k), F.get(s, k + 1)
    f = F.coalesce(F.try_divide(S.clamp(v, F.get(s, F.lit(0)), F.get(s, F.lit(10))) - lo, hi - lo), F.lit(0.0))
    return li.select("l_orderkey", "l_linenumber", F.round(F.get(g, k) + f * (F.get(g, k + 1) - F.get(g, k)), 3).alias("mapped"))


register("quantile_mapped", quantile_mapped, """
WITH q AS (SELECT unnest(range(0, 11)) AS k), s AS (SELECT k, quantile_cont(l_extendedprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])[k + 1] AS s FROM lineitem, q GROUP BY k),
g AS (SELECT k, quantile_cont(o_totalprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])[k + 1] AS g FROM orders, q GROUP BY k),
a AS (SELECT s.k, s AS lo, lead(s) OVER (ORDER BY s.k) AS hi, g AS glo, lead(g) OVER (ORDER BY s.k) AS ghi FROM s JOIN g ON s.k = g.k)
SELECT l_orderkey, l_linenumber, round(glo + (l_extendedprice - lo) / (hi - lo) * (ghi - glo), 3) AS mapped FROM lineitem JOIN a ON (l_extendedprice >= lo OR k = 0) AND (l_extendedprice < hi OR k = 9) WHERE k < 10""")


def decimated(spark, sf_dir):
    """Frame-keyed join of three families, every second cell and third frame kept."""
    f = I.field(spark, sf_dir)
    keep = f.where("x % 2 = 0 and y % 2 = 0 and t % 3 = 0")
    orders = I.table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("long").alias("t")).agg(F.count("*").alias("raw"))
    ship = f.groupBy("t").agg(F.count("*").alias("cells"))
    return keep.join(orders, "t").join(ship, "t").select("t", "x", "y", S.r6(F.col("dx")).alias("dx"), "raw", "cells")


register("decimated", decimated, f"""
WITH {I.FIELD}, o AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, count(*) AS raw FROM orders GROUP BY 1), s AS (SELECT t, count(*) AS cells FROM field GROUP BY t)
SELECT t, x, y, round(dx, 6) AS dx, raw, cells FROM field JOIN o USING (t) JOIN s USING (t) WHERE x % 2 = 0 AND y % 2 = 0 AND t % 3 = 0""")


def initial_reference(spark, sf_dir):
    """In each label the slice with the best mean of its five highest correlations to others, and those five.

    A label's slices are dealt into blocks and pairs of blocks are tasks of one matrix product each; a task keeps the
    five best of each slice, so no pairs are emitted. The work is that of all pairs, as the definition asks."""
    e = I.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("slice"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = e.groupBy("label").agg(F.ceil(F.count("*") / 2048).alias("blocks"))
    e = e.join(sizes, "label").withColumn("mine", F.pmod(F.xxhash64("slice"), F.col("blocks")))
    other = F.explode(F.expr("sequence(0L, blocks - 1)")).alias("b")
    asks = e.select("label", F.col("mine").alias("a"), other, F.lit(True).alias("asks"), "slice", "v")
    told = e.select("label", other.alias("a"), F.col("mine").alias("b"), F.lit(False).alias("asks"), "slice", "v")

    def best_five(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        ask, tell = pdf[pdf.asks], pdf[~pdf.asks]
        out = K.best_correlations(*(np.array(list(x.v), float).reshape(len(x), -1) for x in (ask, tell)), ask.slice.to_numpy(), tell.slice.to_numpy(), 5)
        return pd.DataFrame({"label": pdf.label.iloc[0], "i": out[0], "j": out[1], "r": out[2]})

    r = asks.unionByName(told).groupBy("label", "a", "b").applyInPandas(best_five, "label long, i long, j long, r double")
    top = r.withColumn("k", F.row_number().over(I.over("label", "i").orderBy(F.desc("r"), "j"))).where("k <= 5")
    s = top.groupBy("label", "i").agg(F.round(F.avg("r"), 6).alias("score"), F.array_sort(F.collect_list("j")).alias("nearest"))
    return G.best(s, ["label"], F.desc("score"), "i").select("label", F.col("i").alias("slice"), "score", "nearest")


register("initial_reference", initial_reference, f"""
WITH {I.PIXELS}, m AS (SELECT label, slice, p, v - avg(v) OVER (PARTITION BY slice) AS c FROM pixels), n AS (SELECT label, slice, p, c / sqrt(sum(c*c) OVER (PARTITION BY slice)) AS c FROM m),
r AS (SELECT a.label, a.slice AS i, b.slice AS j, round(sum(a.c * b.c), 9) AS r FROM n a JOIN n b ON a.label = b.label AND a.p = b.p AND a.slice <> b.slice GROUP BY ALL),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label, i ORDER BY r DESC, j) <= 5), s AS (SELECT label, i, round(avg(r), 6) AS score, list_sort(list(j)) AS nearest FROM t GROUP BY ALL)
SELECT label, i AS slice, score, nearest FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, i) = 1""")


def mad_outliers(spark, sf_dir):
    """Cells far from their frame's median, by its MAD; medians come from counts, so a frame's values never meet in one task."""
    p = I.patches(spark, sf_dir)
    m = R.group_quantiles(p, ["t"], "v", {"med": 0.5}).drop("n")
    j = p.join(m, "t").withColumn("d", F.abs(F.col("v") - F.col("med")))
    d = R.group_quantiles(j, ["t"], "d", {"mad": 0.5}).drop("n")
    far = F.when(F.col("mad") > 0, F.col("d") / (1.4826 * F.greatest("mad", F.lit(1e-300))) > 3).otherwise(F.col("d") > 0)
    return j.join(d, "t").where(far).select("t", "site", S.r6(F.col("v")).alias("v"))


register("mad_outliers", mad_outliers, f"""
WITH {I.PATCHES}, j AS (SELECT site, t, v, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY t)) AS d FROM patches), k AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY t) AS mad FROM j)
SELECT t, site, round(v, 6) AS v FROM k WHERE CASE WHEN mad > 0 THEN d / (1.4826 * mad) > 3 ELSE d > 0 END""")


def artifact_reasons(spark, sf_dir):
    """Every episode with the first rule that drops it: coverage, duration, the whole's motion, the border."""
    u = placed(spark, sf_dir)
    motion = I.patches(spark, sf_dir).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("t").cast("long").alias("t"), "v")
    found = E.artifacts(u, E.members(u, reach=REACH, least=LEAST), motion, LEAST, longest=12, most_corr=0.6, edge=1)
    return found.select("episode", "area", "cells", (F.col("t1") - F.col("t0") + 1).alias("frames"), F.round("corr", 5).alias("corr"), S.r6(F.col("edge")).alias("edge"), "reason")


register("artifact_reasons", artifact_reasons, f"""
WITH RECURSIVE {EPISODES}, valid AS (SELECT DISTINCT x, y FROM patches),
cross5 AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j)),
border AS (SELECT x, y FROM valid SEMI JOIN (SELECT x + i AS x, y + j AS y FROM valid, cross5 GROUP BY ALL HAVING count(*) < 5) USING (x, y)),
own AS (SELECT DISTINCT episode, p.x, p.y, e.t0, e.t1 FROM placed p JOIN members USING (node) JOIN episodes e USING (episode)),
whole AS (SELECT t, quantile_cont(v, 0.5) AS whole FROM patches GROUP BY t),
mean AS (SELECT episode, p.t, avg(v) AS own FROM own JOIN patches p ON p.x = own.x AND p.y = own.y AND p.t BETWEEN t0 AND t1 GROUP BY ALL),
c AS (SELECT episode, CASE WHEN var_pop(own) > 1e-12 AND var_pop(whole) > 1e-12 THEN covar_pop(own, whole) / sqrt(var_pop(own) * var_pop(whole)) ELSE 0.0 END AS corr FROM mean JOIN whole USING (t) GROUP BY episode),
b AS (SELECT episode, count(*) AS n FROM own SEMI JOIN border USING (x, y) GROUP BY episode),
d AS (SELECT *, t1 - t0 + 1 AS frames, coalesce(n, 0) / cells AS edge FROM episodes JOIN c USING (episode) LEFT JOIN b USING (episode))
SELECT episode, area, cells, frames, round(corr, 5) AS corr, round(edge, 6) AS edge,
  CASE WHEN cells > 0.5 * (SELECT count(*) FROM valid) THEN 'fov' WHEN frames < 3 THEN 'short' WHEN frames > 12 THEN 'long' WHEN corr > 0.6 THEN 'global' WHEN edge > 0.8 THEN 'edge' ELSE 'kept' END AS reason
FROM d""")


BAD = "bad AS (SELECT x, y FROM cells WHERE dx > 27)"


def bad_cells(spark, sf_dir):
    return I.cells(spark, sf_dir).where("dx > 27").select("x", "y")


def mask_boundary(spark, sf_dir):
    return G.boundary(bad_cells(spark, sf_dir), []).select("x", "y")


register("mask_boundary", mask_boundary, f"""
WITH {I.CELLS}, {BAD}, o AS (SELECT * FROM (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(i, j)), v AS (SELECT x + i AS x, y + j AS y, count(*) AS n FROM bad, o GROUP BY ALL)
SELECT x, y FROM v WHERE n < 5""")


def opened_mask(spark, sf_dir):
    cells = I.cells(spark, sf_dir).where("dx > 24").select("x", "y")
    return G.opening(cells, []).select("x", "y")


register("opened_mask", opened_mask, f"""
WITH {I.CELLS}, a AS (SELECT x, y FROM cells WHERE dx > 24), o AS (SELECT unnest(range(-1, 2)) AS i), p AS (SELECT a.i, b.i AS j FROM o a, o b),
e AS (SELECT x + i AS x, y + j AS y FROM a, p GROUP BY ALL HAVING count(*) = 9) SELECT DISTINCT x + i AS x, y + j AS y FROM e, p""")


def mask_components(spark, sf_dir):
    """Eight-connected components of the mask of at least three cells, with their boxes."""
    cells = bad_cells(spark, sf_dir).withColumn("node", G.cell_key("x", "y"))
    c = C.components(cells.select("node"), G.neighbours(cells, "node", []))
    return cells.join(c, "node").groupBy("component").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("area >= 3")


register("mask_components", mask_components, f"""
WITH RECURSIVE {I.CELLS}, {BAD}, n AS (SELECT x, y, x * 4294967296 + y AS node FROM bad), e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.node <> b.node),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)
SELECT component, count(*) AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM n JOIN c USING (node) GROUP BY component HAVING count(*) >= 3""")


def valid_cells(spark, sf_dir):
    """Cells outside both exclusion masks, and frames common to two families (set operations)."""
    c = I.cells(spark, sf_dir).select("x", "y")
    return c.exceptAll(bad_cells(spark, sf_dir)).intersect(I.cells(spark, sf_dir).where("dy <= 5.2").select("x", "y"))


register("valid_cells", valid_cells, f"WITH {I.CELLS} SELECT x, y FROM cells WHERE NOT dx > 27 AND dy <= 5.2")


def scatter_volume(spark, sf_dir):
    """Trilinear scatter of line items at fractional places into a volume."""
    li = I.table(spark, sf_dir, "lineitem")
    pts = li.select(F.col("l_quantity").alias("v"), (F.col("l_extendedprice") % 4000 / 100).alias("px"), (F.col("l_partkey") % 250 / 10).alias("py"), (F.col("l_discount") * 60).alias("pz"))
    return G.scatter_trilinear(pts, [], "v", 40, 25, 6).select("x", "y", "z", F.round("w", 5).alias("w"), F.round("v", 4).alias("v"))


register("scatter_volume", scatter_volume, """
WITH p AS (SELECT l_quantity AS v, l_extendedprice % 4000 / 100 AS px, l_partkey % 250 / 10 AS py, l_discount * 60 AS pz FROM lineitem), b AS (SELECT unnest([0, 1]) AS b),
c AS (SELECT CAST(floor(px) AS BIGINT) + i.b AS x, CAST(floor(py) AS BIGINT) + j.b AS y, CAST(floor(pz) AS BIGINT) + k.b AS z, v, abs(1 - i.b - (px - floor(px))) * abs(1 - j.b - (py - floor(py))) * abs(1 - k.b - (pz - floor(pz))) AS w FROM p, b i, b j, b k)
SELECT x, y, z, round(sum(w), 5) AS w, round(sum(w * v) / sum(w), 4) AS v FROM c WHERE x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 24 AND z BETWEEN 0 AND 5 GROUP BY ALL HAVING sum(w) > 1e-6""")


def projected_planes(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem")
    pts = li.select(F.col("l_quantity").alias("v"), (F.col("l_extendedprice") % 4000 / 100).alias("px"), (F.col("l_partkey") % 250 / 10).alias("py"), (F.col("l_discount") * 60).alias("pz"))
    return G.splat_max(pts, [1.0, 3.0, 5.0], 0.75, "v", 40, 25).select("plane", "x", "y", "v")


register("projected_planes", projected_planes, """
WITH p AS (SELECT l_quantity AS v, l_extendedprice % 4000 / 100 AS px, l_partkey % 250 / 10 AS py, l_discount * 60 AS pz FROM lineitem), z AS (SELECT * FROM (VALUES (0, 1.0), (1, 3.0), (2, 5.0)) z(plane, z0)), b AS (SELECT unnest([0, 1]) AS b)
SELECT plane, x, y, max(v) AS v FROM (SELECT plane, v, CAST(CASE i.b WHEN 0 THEN floor(px) ELSE ceil(px) END AS BIGINT) AS x, CAST(CASE j.b WHEN 0 THEN floor(py) ELSE ceil(py) END AS BIGINT) AS y FROM p JOIN z ON abs(pz - z0) <= 0.75, b i, b j)
WHERE x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 24 GROUP BY ALL""")


def run_catalog(spark, sf_dir):
    """Artifacts by family with the frame in their names, duplicates counted, common frames marked."""
    p = I.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("frame_"), F.lpad((F.col("page_id") % 100).cast("string"), 4, "0")).alias("stem"), F.when(F.col("page_id") % 3 == 0, "field").otherwise("raw").alias("kind"))
    f = p.withColumn("frame", F.regexp_extract("stem", r"(?<!\d)(\d{1,9})$", 1).cast("int")).groupBy("kind", "frame").agg(F.count("*").alias("files"))
    both = f.where("kind = 'field'").select("frame").intersect(f.where("kind = 'raw'").select("frame")).withColumn("projectable", F.lit(True))
    return f.join(both, "frame", "left").select("kind", "frame", "files", F.coalesce("projectable", F.lit(False)).alias("projectable"))


register("run_catalog", run_catalog, r"""
WITH p AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'field' ELSE 'raw' END AS kind, CAST(regexp_extract('frame_' || lpad(CAST(page_id % 100 AS VARCHAR), 4, '0'), '(\d{1,9})$', 1) AS INT) AS frame FROM pages),
f AS (SELECT kind, frame, count(*) AS files FROM p GROUP BY ALL) SELECT kind, frame, files, count(*) OVER (PARTITION BY frame) = 2 AS projectable FROM f""")


def preceding_reference(spark, sf_dir):
    """Nearest preceding order of the customer for each event of the user, by a running last value."""
    e = I.table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("k"), F.col("ts"), "event_id", F.lit(None).cast("double").alias("price"))
    o = I.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 0 DAY")).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.col("o_totalprice").alias("price"))
    o = o.groupBy("k", "ts").agg(F.max("price").alias("price")).select("k", "ts", F.lit(None).cast("long").alias("event_id"), "price")
    w = I.over("k").orderBy("ts", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("p", F.last("price", True).over(w)).where("event_id is not null").select("event_id", F.round("p", 2).alias("price"))


register("preceding_reference", preceding_reference, """
WITH o AS (SELECT o_custkey % 100 AS k, o_orderdate AS ts, max(o_totalprice) AS price FROM orders GROUP BY ALL), e AS (SELECT event_id, user_id % 100 AS k, ts FROM events)
SELECT event_id, round(price, 2) AS price FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.ts >= o.ts""")
