"""Queries of local support, three-dimensional medians, regions of modes, volume components and plane samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import components as C
from ..operators import grids as G
from ..operators import ranks as R
from ..operators import windows as W
from . import inputs as I
from .registry import register
from .window_plans import UNITS, units


def grid_bounds(p):
    """One row: the number of frames and of the grid's rows."""
    return p.agg(F.max("frames").alias("nt"), (F.max("y") + 1).alias("ny"))


def around(p, reach, place):
    """(t, x, y, a, b, c): the places that each cell looks at, borders by ``place`` (column, size)."""
    rt, rx, ry = reach
    steps = lambda r: F.sequence(F.lit(-r).cast("long"), F.lit(r).cast("long"))
    c = p.select("site", F.col("t").cast("long").alias("t"), "x", "y").join(F.broadcast(grid_bounds(p)))
    c = c.withColumn("i", F.explode(steps(rt))).withColumn("j", F.explode(steps(rx))).withColumn("k", F.explode(steps(ry)))
    return c.select("site", "t", place(F.col("t") + F.col("i"), F.col("nt")).alias("a"), place(F.col("x") + F.col("j"), F.lit(I.WIDTH)).alias("b"), place(F.col("y") + F.col("k"), F.col("ny")).alias("c"))


def clamped(c, n):
    return F.greatest(F.lit(0), F.least(n - 1, c)).cast("long")


def mirrored(c, n):
    m = F.pmod(c, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("long")


def supported_units(spark, sf_dir):
    """Units whose frames have, on average, 15 hundredths of the 27 cells around them active (borders repeated)."""
    p = I.patches(spark, sf_dir)
    active = W.rolling_rest(p, ["site"], "t", "v", 5, 2.0).where("v > rest").select(F.col("t").cast("long").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"), F.lit(1).alias("on"))
    support = around(p, (1, 1, 1), clamped).join(active, ["a", "b", "c"], "left").groupBy("site", "t").agg((F.count("on") / 27).alias("s"))
    u = units(spark, sf_dir)
    each = u.select("site", "t0", "t1", F.explode(F.sequence("t0", "t1")).alias("t")).join(support, ["site", "t"])
    return each.groupBy("site", "t0", "t1").agg(S.r6(F.avg("s")).alias("support")).where("support >= 0.15")


BOUNDS = "bounds AS (SELECT max(frames) AS nt, max(y) + 1 AS ny FROM patches)"
register("supported_units", supported_units, f"""
WITH {I.PATCHES}, {UNITS}, {BOUNDS},
act AS (SELECT p.t, p.x, p.y FROM rest r JOIN patches p ON p.site = r.site AND p.t = r.t WHERE r.v > r.rest),
o AS (SELECT a.i, b.j, c.k FROM (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b, (SELECT unnest([-1, 0, 1]) AS k) c),
s AS (SELECT p.site, p.t, count(act.t) / 27 AS s FROM patches p CROSS JOIN o CROSS JOIN bounds LEFT JOIN act ON act.t = greatest(0, least(nt - 1, p.t + i)) AND act.x = greatest(0, least(14, p.x + j)) AND act.y = greatest(0, least(ny - 1, p.y + k)) GROUP BY ALL)
SELECT u.site, t0, t1, round(avg(s), 6) AS support FROM units u JOIN s ON s.site = u.site AND s.t BETWEEN t0 AND t1 GROUP BY ALL HAVING round(avg(s), 6) >= 0.15""")


def rest_volume(spark, sf_dir):
    """The rest threshold of every cell from its surroundings in time and space: the median over 5 frames x 3 x 3 cells,
    plus twice the median deviation over time, borders mirrored, of an even count the upper of the middle two.

    Time is a window over a site's sorted frames: its values at the five places, mirrored ones from the far side of the
    window; space is an equi-join of nine places, so a row is sent nine times with a short array."""
    p = I.patches(spark, sf_dir).withColumn("t", F.col("t").cast("long"))
    nt = F.col("frames").cast("long")
    middle = lambda c: F.get(F.array_sort(c), F.floor(F.size(c) / 2).cast("int"))

    def windowed(value, half, ahead):
        """Values at t - half .. t + ahead, mirrored at the borders: all that a window of the larger reach holds, picked by place."""
        reach = max(half, ahead)
        seen = F.collect_list(F.struct(F.col("t").alias("t"), F.col(value).alias("v"))).over(I.over("site").orderBy("t").rowsBetween(-reach, reach))
        at = F.map_from_entries(seen)
        return F.transform(F.sequence(F.lit(-half).cast("long"), F.lit(ahead).cast("long")), lambda o: F.element_at(at, mirrored(F.col("t") + o, nt)))

    line = p.select("site", "t", "frames", "x", "y", windowed("v", 2, 2).alias("line"))
    bounds = grid_bounds(p)
    steps = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    near = p.select("site", "t", "x", "y").join(F.broadcast(bounds)).withColumn("j", F.explode(steps)).withColumn("k", F.explode(steps))
    near = near.select("site", "t", mirrored(F.col("x") + F.col("j"), F.lit(I.WIDTH)).alias("b"), mirrored(F.col("y") + F.col("k"), F.col("ny")).alias("c"))
    seen = near.join(line.select("t", F.col("x").alias("b"), F.col("y").alias("c"), "line"), ["t", "b", "c"], "left")
    nothing = F.array_repeat(F.lit(0.0), 5)
    med = seen.groupBy("site", "t").agg(middle(F.flatten(F.collect_list(F.coalesce("line", nothing)))).alias("med"))
    d = p.select("site", "t", "frames", "v").join(med, ["site", "t"]).withColumn("d", F.abs(F.col("v") - F.col("med")))
    frames = I.span(spark, sf_dir)
    width = min(21, max(1, frames // 4))
    d = d.withColumn("mad", middle(windowed("d", width // 2, width - width // 2 - 1)))
    rest = F.col("med") + 2.0 * W.MAD * F.col("mad")
    return d.select("site", "t", S.r6(rest).alias("rest"), (F.col("v") > rest).alias("active"))


register("rest_volume", rest_volume, f"""
WITH {I.PATCHES}, {BOUNDS}, o AS (SELECT a.i, b.j, c.k FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-1, 2)) AS j) b, (SELECT unnest(range(-1, 2)) AS k) c),
w AS (SELECT p.site, p.t, (p.t + i + 2 * nt) % (2 * nt) AS a, (p.x + j + 30) % 30 AS b, (p.y + k + 2 * ny) % (2 * ny) AS c, nt, ny FROM patches p, o, bounds),
m AS (SELECT w.site, w.t, list_sort(list(coalesce(q.v, 0.0)))[count(*) // 2 + 1] AS med FROM w LEFT JOIN patches q ON q.t = CASE WHEN a < nt THEN a ELSE 2 * nt - 1 - a END AND q.x = CASE WHEN b < 15 THEN b ELSE 29 - b END AND q.y = CASE WHEN c < ny THEN c ELSE 2 * ny - 1 - c END GROUP BY ALL),
d AS (SELECT site, t, v, med, abs(v - med) AS d FROM patches JOIN m USING (site, t)),
s AS (SELECT least(21, greatest(1, nt // 4)) AS width, nt FROM bounds),
n AS (SELECT site, t, v, med, (t + o + 2 * nt) % (2 * nt) AS a, nt FROM d, (SELECT nt, unnest(range(-(width // 2), width - width // 2)) AS o FROM s)),
k AS (SELECT n.site, n.t, n.v, n.med, list_sort(list(d.d))[count(*) // 2 + 1] AS mad FROM n JOIN d ON d.site = n.site AND d.t = CASE WHEN a < nt THEN a ELSE 2 * nt - 1 - a END GROUP BY ALL)
SELECT site, t, round(med + 2.0 * 1.4826 * mad, 6) AS rest, v > med + 2.0 * 1.4826 * mad AS active FROM k""")


def mode_regions(spark, sf_dir):
    """Regions of each month's response: cells above a part of its largest, grouped where their closed and widened
    support hangs together; the regions keep their own cells and need four at least."""
    f = I.field(spark, sf_dir).withColumn("a", F.col("dy") * F.col("n"))
    cells = f.withColumn("top", F.max("a").over(I.over("t"))).where(F.col("a") > 0.5 * F.col("top")).select("t", "x", "y", "a", "dx", "dy")
    mask = cells.select("t", "x", "y")
    closed = G.erode(G.dilate(mask, ["t"]), ["t"]).unionByName(mask).distinct()  # padded: nothing is lost at the border
    wide = G.dilate(closed, ["t"])
    wide = wide.withColumn("node", F.shiftleft("t", 40) + F.shiftleft(F.col("x") + 1, 20) + F.col("y") + 1)  # places from -1 up
    c = C.components(wide.select("node"), G.neighbours(wide, "node", ["t"]))
    named = cells.join(wide.join(c, "node"), ["t", "x", "y"])
    w = F.col("a")
    r = named.groupBy("t", "component").agg(F.count("*").alias("area"), F.round(F.sum(w), 4).alias("strength"), F.round(F.sum(w * F.col("x")) / F.sum(w), 5).alias("cx"), F.round(F.sum(w * F.col("y")) / F.sum(w), 5).alias("cy"), F.round(F.sum(w * F.col("dx")) / F.sum(w), 5).alias("mean_dx"), F.round(F.sum(w * F.col("dy")) / F.sum(w), 5).alias("mean_dy"))
    return r.where("area >= 4").drop("component")


register("mode_regions", mode_regions, f"""
WITH RECURSIVE {I.FIELD}, s AS (SELECT t, x, y, dx, dy, dy * n AS a FROM field QUALIFY dy * n > 0.5 * max(dy * n) OVER (PARTITION BY t)),
o AS (SELECT a.i, b.j FROM (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b),
d AS (SELECT DISTINCT t, x + i AS x, y + j AS y FROM s, o), c AS (SELECT t, x + i AS x, y + j AS y FROM d, o GROUP BY ALL HAVING count(*) = 9 UNION SELECT t, x, y FROM s),
w AS (SELECT DISTINCT t, x + i AS x, y + j AS y, (t << 40) + ((x + i + 1) << 20) + y + j + 1 AS node FROM c, o),
e AS (SELECT a.node AS a, b.node AS b FROM w a, o, w b WHERE b.t = a.t AND b.x = a.x + i AND b.y = a.y + j AND a.node <> b.node),
r(node, label) USING KEY (node) AS (SELECT node, node FROM w UNION SELECT e.b, min(r.label) FROM r JOIN e ON r.node = e.a JOIN recurring.r k ON k.node = e.b WHERE r.label < k.label GROUP BY e.b),
m AS (SELECT s.*, label FROM s JOIN w USING (t, x, y) JOIN r USING (node))
SELECT t, count(*) AS area, round(sum(a), 4) AS strength, round(sum(a * x) / sum(a), 5) AS cx, round(sum(a * y) / sum(a), 5) AS cy, round(sum(a * dx) / sum(a), 5) AS mean_dx, round(sum(a * dy) / sum(a), 5) AS mean_dy FROM m GROUP BY t, label HAVING count(*) >= 4""")


def volume_components(spark, sf_dir):
    """Components (26 neighbours) of the mean volume's bright voxels with 2 to 200 voxels."""
    v = I.volume(spark, sf_dir).groupBy("x", "y", "z").agg(F.avg("v").alias("v")).where("v > 36").select("x", "y", "z")
    v = v.withColumn("node", F.shiftleft("x", 40) + F.shiftleft("y", 20) + F.col("z"))
    up = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    near = v.select(F.col("node").alias("a"), "x", "y", "z", F.explode(G.offsets(1)).alias("o")).withColumn("k", up)
    near = near.select("a", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("z") + F.col("k")).alias("z"))
    c = C.components(v.select("node"), near.join(v.withColumnRenamed("node", "b"), ["x", "y", "z"]).where("a > b").select("a", "b"))
    return v.join(c, "node").groupBy("component").agg(F.count("*").alias("size"), F.min("z").alias("z0"), F.max("z").alias("z1")).where("size between 2 and 200")


register("volume_components", volume_components, f"""
WITH RECURSIVE {I.VOLUME}, n AS (SELECT x, y, z, (x << 40) + (y << 20) + z AS node FROM volume GROUP BY x, y, z HAVING avg(v) > 36),
e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.node <> b.node),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)
SELECT component, count(*) AS size, min(z) AS z0, max(z) AS z1 FROM n JOIN c USING (node) GROUP BY component HAVING count(*) BETWEEN 2 AND 200""")


def movie_tiles(spark, sf_dir):
    """Planes 1 to 5 of each year's volume in blocks of 2 x 2, empty voxels left out."""
    v = I.volume(spark, sf_dir).where("z between 1 and 5")
    return G.block_mean(v, ["t", "z"], "x", "y", 2, ["v"], 40, 24).select("t", "z", "bx", "by", S.r6(F.col("v")).alias("v"))


register("movie_tiles", movie_tiles, f"WITH {I.VOLUME} SELECT t, z, x // 2 AS bx, y // 2 AS by, round(avg(v), 6) AS v FROM volume WHERE z BETWEEN 1 AND 5 AND x < 40 AND y < 24 GROUP BY ALL")


def reference_planes(spark, sf_dir):
    """The mean volume at fractional depths: linear between the planes below and above, where both are filled."""
    m = I.volume(spark, sf_dir).groupBy("x", "y", "z").agg(F.avg("v").alias("v"))
    targets = F.explode(F.array(*(F.struct(F.lit(i).alias("plane"), F.lit(z).alias("z0")) for i, z in enumerate((0.5, 2.25, 4.8)))))
    low = m.select("x", "y", "z", F.col("v").alias("a"), targets.alias("p")).where(F.col("z") == F.floor("p.z0"))
    both = low.join(m.select("x", "y", (F.col("z") - 1).alias("z"), F.col("v").alias("b")), ["x", "y", "z"])
    f = F.col("p.z0") - F.col("z")
    return both.select("p.plane", "x", "y", S.r6(F.col("a") * (1 - f) + F.col("b") * f).alias("v"))


register("reference_planes", reference_planes, f"""
WITH {I.VOLUME}, m AS (SELECT x, y, z, avg(v) AS v FROM volume GROUP BY ALL), p AS (SELECT * FROM (VALUES (0, 0.5), (1, 2.25), (2, 4.8)) p(plane, z0))
SELECT plane, a.x, a.y, round(a.v * (1 - (z0 - a.z)) + b.v * (z0 - a.z), 6) AS v FROM p JOIN m a ON a.z = floor(z0) JOIN m b ON b.x = a.x AND b.y = a.y AND b.z = a.z + 1""")


def projection_depths(spark, sf_dir):
    """Depths (dx) of each month and slice: mean between their 5th and 95th percentile, mean, median, the two, and the valid part."""
    f = I.field(spark, sf_dir).select("t", (F.col("y") % 5).alias("k"), F.col("dx").alias("z"))
    q = f.groupBy("t", "k").agg(F.percentile("z", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.avg("z").alias("mean"), F.avg(F.col("z").between(5, 45).cast("int")).alias("valid"))
    j = f.join(q, ["t", "k"])
    inside = F.avg(F.when((F.col("z") >= F.col("q")[0]) & (F.col("z") <= F.col("q")[2]), F.col("z")))
    r = j.groupBy("t", "k").agg(S.r6(inside).alias("trimmed"), *(S.r6(F.first(c)).alias(n) for c, n in ((F.col("mean"), "mean"), (F.col("q")[1], "median"), (F.col("q")[0], "p05"), (F.col("q")[2], "p95"), (F.col("valid"), "valid"))))
    return r


register("projection_depths", projection_depths, f"""
WITH {I.FIELD}, f AS (SELECT t, y % 5 AS k, dx AS z FROM field), q AS (SELECT t, k, quantile_cont(z, 0.05) AS p05, quantile_cont(z, 0.5) AS median, quantile_cont(z, 0.95) AS p95, avg(z) AS mean, avg(CAST(z BETWEEN 5 AND 45 AS INT)) AS valid FROM f GROUP BY ALL)
SELECT t, k, round(avg(z) FILTER (z >= p05 AND z <= p95), 6) AS trimmed, round(mean, 6) AS mean, round(median, 6) AS median, round(p05, 6) AS p05, round(p95, 6) AS p95, round(valid, 6) AS valid FROM f JOIN q USING (t, k) GROUP BY t, k, mean, median, p05, p95, valid""")


def plane_levels(spark, sf_dir):
    """The last month's magnitudes as display levels between its 1st and 99th percentile."""
    f = I.field(spark, sf_dir)
    last = f.agg(F.max("t")).first()[0]  # one number
    v = f.where(F.col("t") == last).select("x", "y", S.norm(F.col("dx"), F.col("dy")).alias("v"))
    lo, hi = R.quantiles(v, "v", [0.01, 0.99])
    return v.select("x", "y", S.r6(F.col("v")).alias("v"), F.rint(S.stretch(F.round("v", 9), F.lit(round(lo, 9)), F.lit(round(hi, 9)), 255.0)).cast("int").alias("level"))


register("plane_levels", plane_levels, f"""
WITH {I.FIELD}, p AS (SELECT x, y, sqrt(dx*dx + dy*dy) AS v FROM field WHERE t = (SELECT max(t) FROM field)), q AS (SELECT round(quantile_cont(v, 0.01), 9) AS lo, round(quantile_cont(v, 0.99), 9) AS hi FROM p)
SELECT x, y, round(v, 6) AS v, CAST(round_even((greatest(lo, least(hi, round(v, 9))) - lo) / (hi - lo + 1e-8) * 255.0, 0) AS INT) AS level FROM p, q""")
