"""Queries of responses, offsets, supports, listings and display slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import components as C
from ..operators import grids as G
from ..operators import ranks as R
from ..operators import windows as W
from . import inputs as I
from .join_plans import ACTIVE, PAIRS, active_cells, bad_cells
from .registry import register
from .window_plans import CLICKS, ONSETS, UNITS, clicked, onsets


def event_hit_rates(spark, sf_dir):
    """Of the windows of four frames after the onsets of a site's region, those that hold an active frame of the site."""
    h = W.hit_rate(clicked(spark, sf_dir), onsets(spark, sf_dir), ["site"], "t", "active", 4, I.span(spark, sf_dir), ["roi"])
    return h.select("site", "windows", "hits", S.r6(F.col("hits") / F.col("windows")).alias("rate"))


register("event_hit_rates", event_hit_rates, f"""
WITH {I.PATCHES}, {CLICKS}, {UNITS}, {ONSETS}, h AS (SELECT site, start, max(CAST(active AS INT)) AS hit FROM onsets JOIN clicks ON site // 15 = roi AND t >= start AND t < start + 4 GROUP BY ALL)
SELECT site, count(*) AS windows, CAST(sum(hit) AS BIGINT) AS hits, round(sum(hit) / count(*), 6) AS rate FROM h GROUP BY site""")


def slice_rows(pixels, values: list[str]):
    """(stack, slice, at, values): a row for each slice with its pixels' places and an array for each value, in their order.

    ``pixels`` are dealt out by stack, and so is all that follows, so that a pixel is shuffled once. The arrays are shared
    places wide: of a pixel that comes twice the values are added, which is what their products with another slice add up to."""
    one = pixels.groupBy("stack", "slice", "p").agg(*(F.sum(k).alias(k) for k in values))
    rows = one.groupBy("stack", "slice").agg(F.array_sort(F.collect_list(F.struct("p", *values))).alias("row"))
    return rows.select("stack", "slice", F.col("row.p").alias("at"), *(F.col(f"row.{k}").alias(k) for k in values))


def best_offsets(slices, values: list[str]):
    """(moving, z0, score): of each moving stack the offset z0 at which slices k and reference slices z0 + 2 k agree best.

    Every 32 vectors are a reference stack and every 8 of them a moving stack, in the order of their ids, so a slice meets
    its own stack's 32 and a pair of them gives one number; a moving stack cut short by the table's end has no curve.
    Slices with different places meet at those that both have."""
    side = lambda name: slices.select("stack", *(F.col(c).alias(f"{name}_{c}") for c in ("slice", "at", *values)))
    k = F.col("a_slice") % 8
    pairs = side("a").join(side("b").hint("merge"), "stack").withColumn("k", k).withColumn("z0", F.col("b_slice") % 32 - 2 * k)
    pairs = pairs.where("z0 between 0 and 17 and arrays_overlap(a_at, b_at)")
    same = F.col("a_at") == F.col("b_at")

    def held(name: str, c: str):
        """The values at the places that both slices have."""
        other = "b" if name == "a" else "a"
        both = F.filter(F.arrays_zip(f"{name}_at", f"{name}_{c}"), lambda x: F.array_contains(f"{other}_at", x[f"{name}_at"]))
        return F.when(same, F.col(f"{name}_{c}")).otherwise(F.transform(both, lambda x: x[f"{name}_{c}"]))

    products = lambda c: F.zip_with(held("a", c), held("b", c), lambda x, y: x * y)
    each = products(values[0])
    for c in values[1:]:
        each = F.zip_with(each, products(c), lambda x, y: x + y)
    known = F.filter(each, lambda x: x.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x))
    s = pairs.select("stack", F.floor(F.col("a_slice") / 8).alias("moving"), "z0", "k", total.alias("r")).groupBy("stack", "moving", "z0")
    s = s.agg(F.round(F.sum("r") / len(values), 6).alias("score"), F.countDistinct("k").alias("n")).where("n = 8")
    return G.best(s, ["stack", "moving"], F.desc("score"), "z0").select("moving", "z0", "score")


def by_stack(spark, sf_dir):
    """(stack, slice, p, v): pixels of the vectors, dealt out by stack before they are taken apart."""
    e = I.table(spark, sf_dir, "embeddings").withColumn("stack", F.floor(F.col("vec_id") / 32)).repartition("stack")
    return e.select("stack", F.col("vec_id").alias("slice"), F.posexplode("embedding").alias("p", "v")).withColumn("v", F.col("v").cast("double"))


def standard(p, k: str):
    """The column with mean 0 and norm 1 in each slice."""
    w = I.over("stack", "slice")
    p = p.withColumn(k, F.col(k) - F.avg(k).over(w))
    return p.withColumn(k, F.try_divide(k, F.sqrt(F.sum(F.col(k) * F.col(k)).over(w))))


def offset_curve(spark, sf_dir):
    """Score of each offset z0: sum over moving slices k of their correlation with reference slice z0 + 2 k; the first best wins."""
    return best_offsets(slice_rows(standard(by_stack(spark, sf_dir), "v"), ["v"]), ["v"])


register("offset_curve", offset_curve, f"""
WITH {I.PIXELS}, m AS (SELECT slice, p, v - avg(v) OVER (PARTITION BY slice) AS c FROM pixels), n AS (SELECT slice, p, c / sqrt(sum(c*c) OVER (PARTITION BY slice)) AS c FROM m),
s AS (SELECT a.slice // 8 AS moving, b.slice % 32 - 2 * (a.slice % 8) AS z0, a.slice % 8 AS k, a.c * b.c AS r FROM n a JOIN n b ON a.slice // 32 = b.slice // 32 AND a.p = b.p WHERE b.slice % 32 - 2 * (a.slice % 8) BETWEEN 0 AND 17),
q AS (SELECT moving, z0, round(sum(r), 6) AS score FROM s GROUP BY ALL HAVING count(DISTINCT k) = 8)
SELECT moving, z0, score FROM q QUALIFY row_number() OVER (PARTITION BY moving ORDER BY score DESC, z0) = 1""")


def gradient_offset_curve(spark, sf_dir):
    """``offset_curve`` with two channels: the mean of the slices' correlation and of their gradients' correlation."""
    w = I.over("stack", "slice").orderBy("p")
    p = by_stack(spark, sf_dir).withColumn("g", F.coalesce(F.col("v") - F.lag("v").over(w), F.lit(0.0)))
    return best_offsets(slice_rows(standard(standard(p, "v"), "g"), ["v", "g"]), ["v", "g"])


register("gradient_offset_curve", gradient_offset_curve, f"""
WITH {I.PIXELS}, g AS (SELECT slice, p, v, coalesce(v - lag(v) OVER (PARTITION BY slice ORDER BY p), 0.0) AS g FROM pixels),
m AS (SELECT slice, p, v - avg(v) OVER (PARTITION BY slice) AS v, g - avg(g) OVER (PARTITION BY slice) AS g FROM g), n AS (SELECT slice, p, v / sqrt(sum(v*v) OVER (PARTITION BY slice)) AS v, g / sqrt(sum(g*g) OVER (PARTITION BY slice)) AS g FROM m),
s AS (SELECT a.slice // 8 AS moving, b.slice % 32 - 2 * (a.slice % 8) AS z0, a.slice % 8 AS k, a.v * b.v + a.g * b.g AS r FROM n a JOIN n b ON a.slice // 32 = b.slice // 32 AND a.p = b.p WHERE b.slice % 32 - 2 * (a.slice % 8) BETWEEN 0 AND 17),
q AS (SELECT moving, z0, round(sum(r) / 2, 6) AS score FROM s GROUP BY ALL HAVING count(DISTINCT k) = 8)
SELECT moving, z0, score FROM q QUALIFY row_number() OVER (PARTITION BY moving ORDER BY score DESC, z0) = 1""")


def mode_support(spark, sf_dir):
    """Cells above half of their month's largest response, with the month's support."""
    f = I.field(spark, sf_dir)
    s = f.withColumn("a", F.col("dy") * F.col("n")).withColumn("top", F.max("a").over(I.over("t"))).where(F.col("a") > 0.5 * F.col("top"))
    return s.groupBy("t").agg(F.count("*").alias("support"), F.min("x").alias("x0"), F.max("x").alias("x1"))


register("mode_support", mode_support, f"""
WITH {I.FIELD}, a AS (SELECT t, x, dy * n AS a, max(dy * n) OVER (PARTITION BY t) AS top FROM field) SELECT t, count(*) AS support, min(x) AS x0, max(x) AS x1 FROM a WHERE a > 0.5 * top GROUP BY t""")


def response_distance(spark, sf_dir):
    """Distance of two months' fields over the cells that both have; three cells at least."""
    f = I.field(spark, sf_dir)
    g = f.select((F.col("t") + 1).alias("t"), "x", "y", F.col("dx").alias("gx"), F.col("dy").alias("gy"))
    j = f.join(g, ["t", "x", "y"])
    dot, a, b = (F.sum(e) for e in (F.col("dx") * F.col("gx") + F.col("dy") * F.col("gy"), F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    d = j.groupBy("t").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("dx") - F.col("gx"), 2) + F.pow(F.col("dy") - F.col("gy"), 2))).alias("l2"), F.try_divide(dot, F.sqrt(a * b)).alias("cosine"))
    return d.where("n >= 3").select("t", "n", S.r6(F.col("l2")).alias("l2"), S.r6(F.col("cosine")).alias("cosine"))


register("response_distance", response_distance, f"""
WITH {I.FIELD} SELECT a.t, count(*) AS n, round(sqrt(avg((a.dx-b.dx)*(a.dx-b.dx) + (a.dy-b.dy)*(a.dy-b.dy))), 6) AS l2,
  round(sum(a.dx*b.dx + a.dy*b.dy) / sqrt(sum(a.dx*a.dx + a.dy*a.dy) * sum(b.dx*b.dx + b.dy*b.dy)), 6) AS cosine
FROM field a JOIN field b ON a.t = b.t + 1 AND a.x = b.x AND a.y = b.y GROUP BY a.t HAVING count(*) >= 3""")


def pair_distance(spark, sf_dir):
    """Weighted distance of region pairs: activation correlation and overlap."""
    pairs = G.pair_overlap(active_cells(spark, sf_dir), "region").where("iou >= 0.1").select("i", "j", "iou")
    p = I.patches(spark, sf_dir).select("site", "t", "v")
    j = pairs.join(p.select(F.col("site").alias("i"), "t", F.col("v").alias("a")), "i").join(p.select(F.col("site").alias("j"), "t", F.col("v").alias("b")), ["j", "t"])
    m = j.groupBy("i", "j", "iou").agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for e, k in ((F.col("a"), "sa"), (F.col("b"), "sb"), (F.col("a") * F.col("a"), "saa"), (F.col("b") * F.col("b"), "sbb"), (F.col("a") * F.col("b"), "sab"))))
    n = F.col("n")
    r = F.try_divide(n * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt((n * F.col("saa") - F.col("sa") * F.col("sa")) * (n * F.col("sbb") - F.col("sb") * F.col("sb"))))
    return m.select("i", "j", F.round(1 - F.abs(r) + 0.5 * (1 - F.col("iou")), 5).alias("distance"))


register("pair_distance", pair_distance, f"""
WITH {I.PATCHES}, {ACTIVE}, {PAIRS}, m AS (SELECT i, j, iou, avg(a.v) AS ma, avg(b.v) AS mb FROM pairs JOIN patches a ON a.site = i JOIN patches b ON b.site = j AND b.t = a.t WHERE iou >= 0.1 GROUP BY ALL),
c AS (SELECT m.i, m.j, m.iou, sum((a.v-ma)*(b.v-mb)) / sqrt(sum((a.v-ma)*(a.v-ma)) * sum((b.v-mb)*(b.v-mb))) AS r FROM m JOIN patches a ON a.site = m.i JOIN patches b ON b.site = m.j AND b.t = a.t GROUP BY ALL)
SELECT i, j, round(1 - abs(r) + 0.5 * (1 - iou), 5) AS distance FROM c""")


def filtered_regions(spark, sf_dir):
    """Sites strong, spread and long enough over their days above 100; days are added in their order, as limits cut sums."""
    p = I.patches(spark, sf_dir).where("v > 100")
    days = I.over("site").orderBy("t")
    so_far = days.rowsBetween(Window.unboundedPreceding, 0)
    r = p.select("site", F.sum("v").over(so_far).alias("s"), F.sum(F.col("v") * F.col("v")).over(so_far).alias("s2"), F.min("t").over(so_far).alias("t0"), F.col("t").alias("t1"), F.lead(F.lit(1)).over(days).alias("more"))
    r = r.where("more is null")
    r = r.withColumn("area_eff", F.col("s") * F.col("s") / F.col("s2")).where((F.col("s") >= 2000) & (F.col("area_eff") >= 6) & (F.col("t1") - F.col("t0") + 1 >= 5))
    return r.select("site", F.round("s", 4).alias("strength"), F.round("area_eff", 5).alias("area_eff"), "t0", "t1")


register("filtered_regions", filtered_regions, f"""
WITH {I.PATCHES}, r AS (SELECT site, sum(v) AS s, sum(v)*sum(v)/sum(v*v) AS e, min(t) AS t0, max(t) AS t1 FROM patches WHERE v > 100 GROUP BY site)
SELECT site, round(s, 4) AS strength, round(e, 5) AS area_eff, t0, t1 FROM r WHERE s >= 2000 AND e >= 6 AND t1 - t0 + 1 >= 5""")


def overlap_matrix(spark, sf_dir):
    """Overlap of event types' user sets: the matrix's entries, a row for each pair of types that share a user."""
    e = I.table(spark, sf_dir, "events").where("value > 60").select("event_type", "user_id").distinct()
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    j = e.join(e.withColumnRenamed("event_type", "other"), "user_id").groupBy("event_type", "other").agg(F.count("*").alias("k"))
    j = j.join(n, "event_type").join(n.select(F.col("event_type").alias("other"), F.col("n").alias("m")), "other")
    return j.select("event_type", "other", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("iou"))


register("overlap_matrix", overlap_matrix, """
WITH e AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 60), n AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1),
j AS (SELECT a.event_type, b.event_type AS other, count(*) AS k FROM e a JOIN e b USING (user_id) GROUP BY ALL)
SELECT j.event_type, other, round(k / (n.n + m.n - k), 6) AS iou FROM j JOIN n ON n.event_type = j.event_type JOIN n m ON m.event_type = other""")


def weighted_planes(spark, sf_dir):
    """Triangular weights around each plane, one pixel each: weighted mean of the samples within reach."""
    li = I.table(spark, sf_dir, "lineitem")
    pts = li.select(F.col("l_quantity").alias("v"), F.floor(F.col("l_extendedprice") % 4000 / 100).alias("x"), F.floor(F.col("l_partkey") % 250 / 10).alias("y"), (F.col("l_discount") * 60).alias("z"))
    near = pts.select("v", "x", "y", "z", F.explode(F.array(*(F.struct(F.lit(i).alias("plane"), F.lit(z).alias("z0")) for i, z in enumerate((1.0, 3.0, 5.0))))).alias("p"))
    w = F.greatest(F.lit(0.0), 1 - F.abs(F.col("z") - F.col("p.z0")) / 1.5)
    return near.withColumn("w", w).where("w > 1e-9").groupBy("p.plane", "x", "y").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 4).alias("v"))


register("weighted_planes", weighted_planes, """
WITH p AS (SELECT l_quantity AS v, CAST(floor(l_extendedprice % 4000 / 100) AS BIGINT) AS x, CAST(floor(l_partkey % 250 / 10) AS BIGINT) AS y, l_discount * 60 AS z FROM lineitem), z AS (SELECT * FROM (VALUES (0, 1.0), (1, 3.0), (2, 5.0)) z(plane, z0)),
w AS (SELECT plane, x, y, v, greatest(0.0, 1 - abs(z - z0) / 1.5) AS w FROM p, z) SELECT plane, x, y, round(sum(w*v)/sum(w), 4) AS v FROM w WHERE w > 1e-9 GROUP BY ALL""")


def supersampled(spark, sf_dir):
    """The mean field on a grid twice as fine, endpoints included: four neighbours joined by cell, linear between them."""
    c = I.cells(spark, sf_dir)
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(79))).alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("j"))
    px, py = F.col("i") * 39.0 / 79.0, F.col("j") * 24.0 / 49.0
    g = grid.select("i", "j", F.least(F.floor(px), F.lit(38)).alias("x0"), F.least(F.floor(py), F.lit(23)).alias("y0"), px.alias("px"), py.alias("py"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    f, h = F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    g = g.select("i", "j", "x0", "y0", f.alias("f"), h.alias("h"), corner.alias("c"))
    g = g.select("i", "j", (F.col("x0") + F.col("c.a")).alias("x"), (F.col("y0") + F.col("c.b")).alias("y"), (F.when(F.col("c.a") == 1, F.col("f")).otherwise(1 - F.col("f")) * F.when(F.col("c.b") == 1, F.col("h")).otherwise(1 - F.col("h"))).alias("w"))
    out = g.join(c, ["x", "y"]).groupBy("i", "j").agg(S.r6(F.sum(F.col("w") * F.col("dx"))).alias("v"), F.count("*").alias("n"))
    return out.where("n = 4").drop("n")  # where all four are filled


register("supersampled", supersampled, f"""
WITH {I.CELLS}, g AS (SELECT i, j, i * 39.0 / 79.0 AS px, j * 24.0 / 49.0 AS py, least(CAST(floor(i * 39.0 / 79.0) AS BIGINT), 38) AS x0, least(CAST(floor(j * 24.0 / 49.0) AS BIGINT), 23) AS y0 FROM (SELECT unnest(range(0, 80)) AS i), (SELECT unnest(range(0, 50)) AS j))
SELECT i, j, round((a.dx*(1-(px-x0)) + b.dx*(px-x0))*(1-(py-y0)) + (c.dx*(1-(px-x0)) + d.dx*(px-x0))*(py-y0), 6) AS v
FROM g JOIN cells a ON a.x=x0 AND a.y=y0 JOIN cells b ON b.x=x0+1 AND b.y=y0 JOIN cells c ON c.x=x0 AND c.y=y0+1 JOIN cells d ON d.x=x0+1 AND d.y=y0+1""")


def matched_histogram(spark, sf_dir):
    """Each customer's balance by the supplier's balance of the same rank in the nation: ranks joined by equality."""
    c, o = I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "supplier")
    w = I.over("s_nationkey")
    tgt = o.select(F.col("s_nationkey").alias("nation"), "s_acctbal", F.row_number().over(w.orderBy("s_acctbal", "s_suppkey")).alias("k"), F.count("*").over(w).alias("n"))
    cdf = c.select("c_custkey", F.col("c_nationkey").alias("nation"), F.cume_dist().over(I.over("c_nationkey").orderBy("c_acctbal")).alias("q"))
    j = cdf.join(tgt, "nation").where(F.col("k") == F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 9))))
    return j.select("c_custkey", F.round("s_acctbal", 2).alias("matched"))


register("matched_histogram", matched_histogram, """
WITH q AS (SELECT c_custkey, c_nationkey AS nation, cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS q FROM customer),
t AS (SELECT s_nationkey AS nation, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT c_custkey, round(s_acctbal, 2) AS matched FROM q JOIN t ON q.nation = t.nation AND k = greatest(1, CAST(ceil(round(q * n, 9)) AS INT))""")


def best_slices(spark, sf_dir):
    """In each month the slice with the largest p99 (first wins), and the one with the largest value."""
    f = I.field(spark, sf_dir).groupBy("t", (F.col("y") % 5).alias("z")).agg(F.round(F.percentile("dy", F.lit(0.99)), 9).alias("p99"), F.max("dy").alias("top"))
    return f.groupBy("t").agg(F.max_by("z", F.struct("p99", -F.col("z"))).alias("by_top1"), F.max_by("z", F.struct("top", -F.col("z"))).alias("by_max"))


register("best_slices", best_slices, f"""
WITH {I.FIELD}, z AS (SELECT t, y % 5 AS z, round(quantile_cont(dy, 0.99), 9) AS p99, max(dy) AS top FROM field GROUP BY ALL)
SELECT t, arg_max(z, (p99, -z)) AS by_top1, arg_max(z, (top, -z)) AS by_max FROM z GROUP BY t""")


def top_components(spark, sf_dir):
    """The five components of the mask with the highest peaks: area, peak, mean and weighted place (a report of five)."""
    cells = bad_cells(spark, sf_dir).join(I.cells(spark, sf_dir), ["x", "y"]).withColumn("node", G.cell_key("x", "y"))
    c = C.components(cells.select("node"), G.neighbours(cells.select("x", "y", "node"), "node", []))
    r = cells.join(c, "node").groupBy("component").agg(F.count("*").alias("area"), S.r6(F.max("dx")).alias("peak"), S.r6(F.avg("dx")).alias("mean"), F.round(F.sum(F.col("dx") * F.col("x")) / F.sum("dx"), 5).alias("cx")).where("area >= 3")
    return r.orderBy(F.desc("peak"), "component").limit(5)


register("top_components", top_components, f"""
WITH RECURSIVE {I.CELLS}, bad AS (SELECT x, y, dx FROM cells WHERE dx > 27), n AS (SELECT x, y, dx, x * 4294967296 + y AS node FROM bad), e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.node <> b.node),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)
SELECT component, count(*) AS area, round(max(dx), 6) AS peak, round(avg(dx), 6) AS mean, round(sum(dx * x) / sum(dx), 5) AS cx FROM n JOIN c USING (node) GROUP BY component HAVING count(*) >= 3 ORDER BY peak DESC, component LIMIT 5""")


def bad_boxes(spark, sf_dir):
    """Control points whose error is an outlier, in components of two at least (four neighbours), as padded boxes."""
    c = I.cells(spark, sf_dir).where("x % 2 = 1 and y % 2 = 1").select(((F.col("x") - 1) / 2).cast("long").alias("x"), ((F.col("y") - 1) / 2).cast("long").alias("y"), "dx")
    med = R.quantiles(c, "dx", [0.5])[0]
    d = c.withColumn("d", F.abs(F.col("dx") - F.lit(med)))
    mad = R.quantiles(d, "d", [0.5])[0]
    bad = d.where(F.col("d") > 1.4826 * F.lit(mad)).select("x", "y").withColumn("node", G.cell_key("x", "y"))
    comp = C.components(bad.select("node"), G.neighbours(bad, "node", [], False))
    return bad.join(comp, "node").groupBy("component").agg(F.count("*").alias("points"), F.greatest(F.lit(0), F.min("x") * 2 - 1).alias("x0"), F.least(F.lit(39), F.max("x") * 2 + 3).alias("x1"), F.greatest(F.lit(0), F.min("y") * 2 - 1).alias("y0"), F.least(F.lit(24), F.max("y") * 2 + 3).alias("y1")).where("points >= 2")


register("bad_boxes", bad_boxes, f"""
WITH RECURSIVE {I.CELLS}, c AS (SELECT (x - 1) // 2 AS x, (y - 1) // 2 AS y, dx FROM cells WHERE x % 2 = 1 AND y % 2 = 1), d AS (SELECT x, y, abs(dx - (SELECT quantile_cont(dx, 0.5) FROM c)) AS d FROM c),
n AS (SELECT x, y, x * 4294967296 + y AS node FROM d WHERE d > 1.4826 * (SELECT quantile_cont(d, 0.5) FROM d)), e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), k AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)
SELECT component, count(*) AS points, greatest(0, min(x)*2 - 1) AS x0, least(39, max(x)*2 + 3) AS x1, greatest(0, min(y)*2 - 1) AS y0, least(24, max(y)*2 + 3) AS y1 FROM n JOIN k USING (node) GROUP BY component HAVING count(*) >= 2""")


def page_arithmetic(spark, sf_dir):
    """Pages of volumes and movies, and rows of a table in a stable order over several keys."""
    p = I.table(spark, sf_dir, "part")
    page = F.col("p_size") * 2 + F.col("p_partkey") % 2
    order = F.row_number().over(I.over(F.substring("p_brand", 1, 7)).orderBy(F.desc("p_size"), "p_retailprice", "p_partkey"))
    return p.select("p_partkey", page.cast("long").alias("page"), (F.col("p_partkey") * 20 + F.col("p_size") % 20).alias("movie_page"), order.alias("place"))


register("page_arithmetic", page_arithmetic, """
SELECT p_partkey, CAST(p_size * 2 + p_partkey % 2 AS BIGINT) AS page, p_partkey * 20 + p_size % 20 AS movie_page,
  row_number() OVER (PARTITION BY substr(p_brand, 1, 7) ORDER BY p_size DESC, p_retailprice, p_partkey) AS place FROM part""")
