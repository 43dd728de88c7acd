"""Queries of block, moment, percentile and rollup aggregates and of error metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grids as G
from ..operators import ranks as R
from . import inputs as I
from .registry import register


def block_mean(spark, sf_dir):
    b = G.block_mean(I.field(spark, sf_dir), ["t"], "x", "y", 2, ["dx", "dy"], 40, 25)
    return b.select("t", "bx", "by", S.r6(F.col("dx")).alias("dx"), S.r6(F.col("dy")).alias("dy"))


register("block_mean", block_mean, f"""
WITH {I.FIELD} SELECT t, x // 2 AS bx, y // 2 AS by, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy FROM field WHERE x < 40 AND y < 24 GROUP BY ALL""")


def patch_motion(spark, sf_dir):
    """Block means of the field and their change against the month before, for blocks that are filled enough."""
    f = I.field(spark, sf_dir)
    b = G.block_mean(f, ["t"], "x", "y", 5, ["dx", "dy"], 40, 25)
    mask = f.groupBy(F.floor(F.col("x") / 5).alias("bx"), F.floor(F.col("y") / 5).alias("by")).agg(F.avg((F.col("n") > 1).cast("int")).alias("m")).where("m > 0.05")
    w = I.over("bx", "by").orderBy("t")
    d = b.join(mask, ["bx", "by"]).select("t", "bx", "by", *((F.col(c) - F.lag(c).over(w)).alias(c) for c in ("dx", "dy")), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    return d.where("dx is not null").select("t", "bx", "by", *(S.r6(F.col(c)).alias(c) for c in ("dx", "dy", "ax", "ay")))


register("patch_motion", patch_motion, f"""
WITH {I.FIELD}, b AS (SELECT t, x // 5 AS bx, y // 5 AS "by", avg(dx) AS ax, avg(dy) AS ay FROM field GROUP BY ALL),
m AS (SELECT x // 5 AS bx, y // 5 AS "by" FROM field GROUP BY ALL HAVING avg(CAST(n > 1 AS INT)) > 0.05),
d AS (SELECT t, bx, "by", ax - lag(ax) OVER w AS dx, ay - lag(ay) OVER w AS dy, ax, ay FROM b JOIN m USING (bx, "by") WINDOW w AS (PARTITION BY bx, "by" ORDER BY t))
SELECT t, bx, "by", round(dx, 6) AS dx, round(dy, 6) AS dy, round(ax, 6) AS ax, round(ay, 6) AS ay FROM d WHERE dx IS NOT NULL""")


def global_motion(spark, sf_dir):
    """Median and mean displacement of every frame; medians come from counts, so a frame's values never meet in one task."""
    f = I.field(spark, sf_dir)
    out = f.groupBy("t").agg(S.r6(F.avg("dx")).alias("mean_x"), S.r6(F.avg("dy")).alias("mean_y"))
    for axis in ("x", "y"):
        median = R.group_quantiles(f, ["t"], f"d{axis}", {f"median_{axis}": 0.5}).select("t", S.r6(F.col(f"median_{axis}")).alias(f"median_{axis}"))
        out = out.join(median, "t")
    return out.select("t", "median_x", "median_y", "mean_x", "mean_y")


register("global_motion", global_motion, f"""
WITH {I.FIELD} SELECT t, round(quantile_cont(dx, 0.5), 6) AS median_x, round(quantile_cont(dy, 0.5), 6) AS median_y, round(avg(dx), 6) AS mean_x, round(avg(dy), 6) AS mean_y FROM field GROUP BY t""")


def spatial_stats(spark, sf_dir):
    s = G.weighted_stats(I.field(spark, sf_dir), ["t"], "dx")
    return s.select("t", *(F.round(c, 4).alias(c) for c in ("strength", "area_eff", "cx", "cy", "vxx", "vyy", "vxy")))


register("spatial_stats", spatial_stats, f"""
WITH {I.FIELD}, m AS (SELECT t, sum(dx) AS s, sum(dx*dx) AS s2, sum(dx*x)/sum(dx) AS cx, sum(dx*y)/sum(dx) AS cy FROM field GROUP BY t),
v AS (SELECT f.t, sum(dx*(x-cx)*(x-cx))/min(s) AS vxx, sum(dx*(y-cy)*(y-cy))/min(s) AS vyy, sum(dx*(x-cx)*(y-cy))/min(s) AS vxy FROM field f JOIN m USING (t) GROUP BY f.t)
SELECT t, round(s, 4) AS strength, round(s*s/s2, 4) AS area_eff, round(cx, 4) AS cx, round(cy, 4) AS cy, round(vxx, 4) AS vxx, round(vyy, 4) AS vyy, round(vxy, 4) + 0.0 AS vxy FROM m JOIN v USING (t)""")


def weighted_response(spark, sf_dir):
    """Mean response vector and centroid of each region, weighted by the order's price; regions are nations."""
    c, o = I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "orders")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    w = F.col("o_totalprice")
    return j.groupBy("c_nationkey").agg(F.round(F.sum(w * F.col("c_acctbal")) / F.sum(w), 4).alias("vx"), F.round(F.sum(w * (F.col("o_orderkey") % 40)) / F.sum(w), 4).alias("cx"), F.count("*").alias("n"))


register("weighted_response", weighted_response, """
SELECT c_nationkey, round(sum(o_totalprice * c_acctbal) / sum(o_totalprice), 4) AS vx, round(sum(o_totalprice * (o_orderkey % 40)) / sum(o_totalprice), 4) AS cx, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")


def episode_summary(spark, sf_dir):
    from .window_plans import units

    u = units(spark, sf_dir).groupBy("t0", "t1").agg(F.count("*").alias("area"))
    d = F.col("t1") - F.col("t0") + 1
    q = lambda c: F.percentile(c, F.lit(0.5))
    return u.agg(F.count("*").alias("episodes"), F.min("area").alias("min_area"), q(F.col("area")).alias("median_area"), F.max("area").alias("max_area"), F.min(d).alias("min_frames"), q(d).alias("median_frames"), F.max(d).alias("max_frames"))


def _units_sql() -> str:
    from .window_plans import UNITS

    return f"{I.PATCHES}, {UNITS}"


register("episode_summary", episode_summary, f"""
WITH {_units_sql()}, e AS (SELECT t0, t1, count(*) AS area, t1 - t0 + 1 AS d FROM units GROUP BY t0, t1)
SELECT count(*) AS episodes, min(area) AS min_area, quantile_cont(area, 0.5) AS median_area, max(area) AS max_area, min(d) AS min_frames, quantile_cont(d, 0.5) AS median_frames, max(d) AS max_frames FROM e""")


def coverage_rollup(spark, sf_dir):
    """Hole fraction by month and plane with both totals, from one rollup (a plane is a column of cells)."""
    f = I.field(spark, sf_dir).withColumn("k", F.floor(F.col("y") / 5))
    return f.rollup("t", "k").agg(S.r6(1 - F.avg((F.col("n") >= 2).cast("int"))).alias("hole_frac"), F.count("*").alias("cells"))


register("coverage_rollup", coverage_rollup, f"""
WITH {I.FIELD} SELECT t, y // 5 AS k, round(1 - avg(CAST(n >= 2 AS INT)), 6) AS hole_frac, count(*) AS cells FROM field GROUP BY ROLLUP (t, y // 5)""")


def worst_plane(spark, sf_dir):
    f = I.field(spark, sf_dir).groupBy("t", F.floor(F.col("y") / 5).alias("k")).agg(F.round(1 - F.avg((F.col("n") >= 2).cast("int")), 9).alias("h"))
    return f.groupBy("t").agg(S.r6(F.avg("h")).alias("mean_hole"), S.r6(F.max("h")).alias("max_hole"), F.max_by("k", F.struct("h", -F.col("k"))).alias("worst"))


register("worst_plane", worst_plane, f"""
WITH {I.FIELD}, h AS (SELECT t, y // 5 AS k, round(1 - avg(CAST(n >= 2 AS INT)), 9) AS h FROM field GROUP BY ALL)
SELECT t, round(avg(h), 6) AS mean_hole, round(max(h), 6) AS max_hole, arg_max(k, (h, -k)) AS worst FROM h GROUP BY t""")


def hierarchy_cube(spark, sf_dir):
    r, n, c, o = (I.table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.cube("r_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("o_custkey").alias("customers"))


register("hierarchy_cube", hierarchy_cube, """
SELECT r_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""")


def trimmed_means(spark, sf_dir):
    """By slice: trimmed mean within p05..p95, mean, median, both bounds and the part that lies inside."""
    f = I.field(spark, sf_dir)
    p = f.groupBy("t").agg(F.percentile("dx", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p"))
    inside = (F.col("dx") >= F.col("p")[0]) & (F.col("dx") <= F.col("p")[2])
    g = f.join(p, "t").groupBy("t").agg(F.avg(F.when(inside, F.col("dx"))).alias("trimmed"), F.avg("dx").alias("mean"), F.first("p").alias("p"), F.avg(inside.cast("int")).alias("valid"))
    return g.select("t", S.r6(F.col("trimmed")).alias("trimmed"), S.r6(F.col("mean")).alias("mean"), S.r6(F.col("p")[1]).alias("median"), S.r6(F.col("p")[0]).alias("p05"), S.r6(F.col("p")[2]).alias("p95"), S.r6(F.col("valid")).alias("valid_ratio"))


register("trimmed_means", trimmed_means, f"""
WITH {I.FIELD}, p AS (SELECT t, quantile_cont(dx, 0.05) AS lo, quantile_cont(dx, 0.5) AS med, quantile_cont(dx, 0.95) AS hi FROM field GROUP BY t)
SELECT t, round(avg(dx) FILTER (dx BETWEEN lo AND hi), 6) AS trimmed, round(avg(dx), 6) AS mean, round(min(med), 6) AS median, round(min(lo), 6) AS p05, round(min(hi), 6) AS p95,
  round(avg(CAST(dx BETWEEN lo AND hi AS INT)), 6) AS valid_ratio FROM field JOIN p USING (t) GROUP BY t""")


def field_summary(spark, sf_dir):
    f = I.field(spark, sf_dir).withColumn("m", S.norm(F.col("dx"), F.col("dy"))).where(~F.isnan("m"))
    return f.groupBy("t", (F.col("y") % 5).alias("z")).agg(S.r6(F.avg("m")).alias("mean"), S.r6(F.percentile("m", F.lit(0.95))).alias("p95"), S.r6(F.max("m")).alias("max"))


register("field_summary", field_summary, f"""
WITH {I.FIELD}, m AS (SELECT t, y % 5 AS z, sqrt(dx*dx + dy*dy) AS m FROM field) SELECT t, z, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.95), 6) AS p95, round(max(m), 6) AS max FROM m GROUP BY ALL""")


def support_fraction(spark, sf_dir):
    return I.patches(spark, sf_dir).groupBy("t").agg(S.r6(F.avg((F.col("v") > 0).cast("int"))).alias("support"), F.count("*").alias("patches"))


register("support_fraction", support_fraction, f"WITH {I.PATCHES} SELECT t, round(avg(CAST(v > 0 AS INT)), 6) AS support, count(*) AS patches FROM patches GROUP BY t")


def motion_errors(spark, sf_dir):
    """End-point errors of the field against the month before it, plain and with the second axis scaled."""
    f = I.field(spark, sf_dir)
    g = f.select((F.col("t") + 1).alias("t"), "x", "y", F.col("dx").alias("gx"), F.col("dy").alias("gy"))
    e = f.join(g, ["t", "x", "y"]).select("t", (F.col("dx") - F.col("gx")).alias("ex"), (F.col("dy") - F.col("gy")).alias("ey"))
    epe, phys = S.norm(F.col("ex"), F.col("ey")), S.norm(F.col("ex"), F.col("ey") * 2)
    return e.groupBy("t").agg(S.r6(F.avg(epe)).alias("epe_mean"), S.r6(F.percentile(epe, F.lit(0.5))).alias("epe_median"), S.r6(F.avg(phys)).alias("epe_physical"), *(x for c in ("ex", "ey") for x in (S.r6(F.sqrt(F.avg(F.col(c) * F.col(c)))).alias(f"rmse_{c}"), S.r6(F.avg(F.abs(c))).alias(f"mae_{c}"))))


register("motion_errors", motion_errors, f"""
WITH {I.FIELD}, e AS (SELECT a.t, a.dx - b.dx AS ex, a.dy - b.dy AS ey FROM field a JOIN field b ON a.t = b.t + 1 AND a.x = b.x AND a.y = b.y)
SELECT t, round(avg(sqrt(ex*ex+ey*ey)), 6) AS epe_mean, round(quantile_cont(sqrt(ex*ex+ey*ey), 0.5), 6) AS epe_median, round(avg(sqrt(ex*ex+4*ey*ey)), 6) AS epe_physical,
  round(sqrt(avg(ex*ex)), 6) AS rmse_ex, round(avg(abs(ex)), 6) AS mae_ex, round(sqrt(avg(ey*ey)), 6) AS rmse_ey, round(avg(abs(ey)), 6) AS mae_ey FROM e GROUP BY t""")


def correlation_scores(spark, sf_dir):
    """Weighted zero-mean correlation of each slice with its label's mean slice; none where one is flat."""
    p = I.pixels(spark, sf_dir)
    ref = p.groupBy("label", "p").agg(F.avg("v").alias("r"))
    w = F.greatest(S.hann(F.col("p"), 64), F.lit(1e-3))
    j = p.join(ref, ["label", "p"]).withColumn("w", w)
    m = j.groupBy("slice").agg(F.sum("w").alias("s"), *(F.sum(F.col("w") * e).alias(n) for e, n in ((F.col("v"), "a"), (F.col("r"), "b"), (F.col("v") * F.col("v"), "aa"), (F.col("r") * F.col("r"), "bb"), (F.col("v") * F.col("r"), "ab"))))
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("s"), F.col("bb") - F.col("b") * F.col("b") / F.col("s")
    return m.where((va > 1e-9) & (vb > 1e-9)).select("slice", F.round((F.col("ab") - F.col("a") * F.col("b") / F.col("s")) / F.sqrt(va * vb), 5).alias("zncc"))


register("correlation_scores", correlation_scores, f"""
WITH {I.PIXELS}, ref AS (SELECT label, p, avg(v) AS r FROM pixels GROUP BY ALL),
j AS (SELECT slice, v, r, greatest(0.5 * (1 - cos(2 * pi() * p / 63)), 1e-3) AS w FROM pixels JOIN ref USING (label, p)),
c AS (SELECT slice, sum(w) AS s, sum(w*v)/sum(w) AS ma, sum(w*r)/sum(w) AS mb FROM j GROUP BY slice),
d AS (SELECT slice, sum(w*(v-ma)*(r-mb)) AS ab, sum(w*(v-ma)*(v-ma)) AS aa, sum(w*(r-mb)*(r-mb)) AS bb FROM j JOIN c USING (slice) GROUP BY slice)
SELECT slice, round(ab / sqrt(aa*bb), 5) AS zncc FROM d WHERE aa > 1e-9 AND bb > 1e-9""")


def frame_errors(spark, sf_dir):
    """Mean absolute error by plane, normalised by the plane's p1..p99 range, then averaged over planes of a month."""
    f = I.field(spark, sf_dir)
    g = f.select((F.col("t") + 1).alias("t"), "x", "y", F.col("dx").alias("gx"))
    j = f.join(g, ["t", "x", "y"]).groupBy("t", (F.col("y") % 5).alias("k")).agg(F.avg(F.abs(F.col("dx") - F.col("gx"))).alias("mae"), F.percentile("dx", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    return j.groupBy("t").agg(S.r6(F.avg("mae")).alias("mae"), F.round(F.avg(F.try_divide(F.col("mae"), F.col("p")[1] - F.col("p")[0])), 5).alias("nmae"))


register("frame_errors", frame_errors, f"""
WITH {I.FIELD}, k AS (SELECT a.t, a.y % 5 AS k, avg(abs(a.dx - b.dx)) AS mae, quantile_cont(a.dx, 0.99) - quantile_cont(a.dx, 0.01) AS r FROM field a JOIN field b ON a.t = b.t + 1 AND a.x = b.x AND a.y = b.y GROUP BY ALL)
SELECT t, round(avg(mae), 6) AS mae, round(avg(CASE WHEN r <> 0 THEN mae / r END), 5) AS nmae FROM k GROUP BY t""")


def objective(spark, sf_dir):
    """Mean squared residual and the penalty's share of the objective."""
    f = I.field(spark, sf_dir).withColumn("r", F.col("dx") - 25)
    return f.groupBy("t").agg(S.r6(F.avg(F.col("r") * F.col("r"))).alias("data"), S.r6(F.sum(F.col("dy") * F.col("dy")) * 0.1 / F.count("*")).alias("penalty"))


register("objective", objective, f"WITH {I.FIELD} SELECT t, round(avg((dx - 25) * (dx - 25)), 6) AS data, round(sum(dy * dy) * 0.1 / count(*), 6) AS penalty FROM field GROUP BY t")


def smoothness_scale(spark, sf_dir):
    """Mean squared central difference along both axes, averaged over the axes."""
    c = I.cells(spark, sf_dir)
    diff = lambda a, b: (F.lead("dx").over(I.over(a).orderBy(b)) - F.lag("dx").over(I.over(a).orderBy(b))) / 2
    d = c.select(diff("y", "x").alias("gx"), diff("x", "y").alias("gy"))
    return d.agg(S.r6((F.avg(F.col("gx") * F.col("gx")) + F.avg(F.col("gy") * F.col("gy"))) / 2).alias("scale"))


register("smoothness_scale", smoothness_scale, f"""
WITH {I.CELLS}, d AS (SELECT (lead(dx) OVER (PARTITION BY y ORDER BY x) - lag(dx) OVER (PARTITION BY y ORDER BY x)) / 2 AS gx, (lead(dx) OVER (PARTITION BY x ORDER BY y) - lag(dx) OVER (PARTITION BY x ORDER BY y)) / 2 AS gy FROM cells)
SELECT round((avg(gx*gx) + avg(gy*gy)) / 2, 6) AS scale FROM d""")


def structural_scale(spark, sf_dir):
    """p99 of differences over reliable cells; with too few of them the threshold falls to the k-th largest reliability."""
    f = I.field(spark, sf_dir).select("t", "x", "y", F.col("dx").alias("diff"), (F.col("dy") / 10).alias("r"))
    k = f.where("r > 0").withColumn("k", F.row_number().over(I.over("t").orderBy(F.desc("r"), "x", "y")))
    low = k.groupBy("t").agg(F.sum((F.col("r") >= 0.8).cast("int")).alias("n"), F.min(F.when(F.col("k") <= 150, F.col("r"))).alias("kth"))
    th = low.select("t", F.when(F.col("n") >= 150, F.lit(0.8)).otherwise(F.col("kth")).alias("th"), (F.col("n") < 150).alias("lowered"))
    j = f.join(th, "t").where("r >= th")
    return j.groupBy("t").agg(S.r6(F.greatest(F.percentile("diff", F.lit(0.99)), F.lit(1e-6))).alias("scale"), F.count("*").alias("n"), F.first("lowered").alias("lowered"))


register("structural_scale", structural_scale, f"""
WITH {I.FIELD}, f AS (SELECT t, x, y, dx AS diff, dy / 10 AS r FROM field), k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r DESC, x, y) AS k FROM f WHERE r > 0),
th AS (SELECT t, CASE WHEN count(*) FILTER (r >= 0.8) >= 150 THEN 0.8 ELSE min(r) FILTER (k <= 150) END AS th, count(*) FILTER (r >= 0.8) < 150 AS lowered FROM k GROUP BY t)
SELECT t, round(greatest(quantile_cont(diff, 0.99), 1e-6), 6) AS scale, count(*) AS n, any_value(lowered) AS lowered FROM f JOIN th USING (t) WHERE r >= th GROUP BY t""")


def temporal_basis(spark, sf_dir):
    """Peak frame, participation ratio and normalised entropy of each site's activation; days are added in their order."""
    p = I.patches(spark, sf_dir)
    w = I.over("site").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = p.withColumn("q", F.try_divide(F.abs("v"), F.sum(F.abs("v")).over(w))).where("q is not null")
    g = s.groupBy("site").agg(F.max_by("t", F.struct("v", -F.col("t"))).alias("peak_t"), S.r6(F.max("q")).alias("peak_frac"), F.round(1 / F.sum(F.col("q") * F.col("q")), 5).alias("participation"), F.round(-F.sum(F.when(F.col("q") > 0, F.col("q") * F.log("q")).otherwise(0.0)) / F.log(F.max("frames")), 6).alias("entropy"))
    return g


register("temporal_basis", temporal_basis, f"""
WITH {I.PATCHES}, q AS (SELECT site, t, frames, v, abs(v) / nullif(sum(abs(v)) OVER (PARTITION BY site), 0) AS q FROM patches)
SELECT site, arg_max(t, (v, -t)) AS peak_t, round(max(q), 6) AS peak_frac, round(1 / sum(q*q), 5) AS participation, round(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(max(frames)), 6) AS entropy FROM q WHERE q IS NOT NULL GROUP BY site""")


def robust_line(spark, sf_dir):
    """Linear fit of one component on the other over reliable cells."""
    f = I.field(spark, sf_dir).where("n >= 2 and dx is not null")
    return f.groupBy("t").agg(F.count("*").alias("n"), F.regr_slope("dy", "dx").alias("a"), F.regr_intercept("dy", "dx").alias("b")).where("n >= 3").select("t", "n", F.round("a", 5).alias("slope"), F.round("b", 4).alias("intercept"))


register("robust_line", robust_line, f"""
WITH {I.FIELD} SELECT t, count(*) AS n, round(regr_slope(dy, dx), 5) AS slope, round(regr_intercept(dy, dx), 4) AS intercept FROM field WHERE n >= 2 GROUP BY t HAVING count(*) >= 3""")


def method_table(spark, sf_dir):
    """Mean error of each method by variable and file, methods side by side, and its spread over repetitions."""
    li = I.table(spark, sf_dir, "lineitem")
    e = li.select("l_linestatus", F.year("l_shipdate").alias("file"), "l_returnflag", (F.col("l_extendedprice") * F.col("l_discount")).alias("e"))
    return e.groupBy("l_linestatus", "file").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("e"), 4))


register("method_table", method_table, """
WITH e AS (SELECT l_linestatus, year(l_shipdate) AS file, l_returnflag, l_extendedprice * l_discount AS e FROM lineitem)
SELECT l_linestatus, file, round(avg(e) FILTER (l_returnflag = 'A'), 4) AS A, round(avg(e) FILTER (l_returnflag = 'N'), 4) AS N, round(avg(e) FILTER (l_returnflag = 'R'), 4) AS R FROM e GROUP BY ALL""")


def repetition_table(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem")
    r = li.groupBy("l_returnflag", "l_linenumber", (F.col("l_orderkey") % 10).alias("rep")).agg(F.avg("l_extendedprice").alias("e"))
    return r.groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("e"), 4).alias("mean"), F.round(F.stddev_samp("e"), 4).alias("std"))


register("repetition_table", repetition_table, """
WITH r AS (SELECT l_returnflag, l_linenumber, l_orderkey % 10 AS rep, avg(l_extendedprice) AS e FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, round(avg(e), 4) AS mean, round(stddev_samp(e), 4) AS std FROM r GROUP BY ALL""")
