"""Queries of scalar transforms and contrast rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranks as R
from . import inputs as I
from .registry import register


def channel_transform(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.select("l_orderkey", "l_linenumber", *(S.r6(S.transform(q, 2.0, m)).alias(m) for m in ("raw", "sqrt", "log2", "log10")))


register("channel_transform", channel_transform, """
SELECT l_orderkey, l_linenumber, round(2.0 * l_quantity, 6) AS raw, round(2.0 * sqrt(l_quantity), 6) AS sqrt,
  round(2.0 * ln(1 + l_quantity) / ln(2.0), 6) AS log2, round(2.0 * log10(1 + l_quantity), 6) AS log10 FROM lineitem""")


def fuse_channels(spark, sf_dir):
    p = I.patches(spark, sf_dir)
    ca = I.daily(spark, sf_dir, "event_type").where("event_type = 'purchase'").select(F.col("user_id").alias("site"), "t", F.col("v").alias("ca"))
    return p.join(ca, ["site", "t"], "left").select("site", "t", S.r6(S.fuse(F.col("v"), F.col("ca"), 1.0, "sqrt")).alias("fused"))


register("fuse_channels", fuse_channels, f"""
WITH {I.PATCHES}, ca AS (SELECT user_id, t, sum(value) AS ca FROM ev WHERE event_type = 'purchase' GROUP BY ALL)
SELECT site, p.t, round(CASE WHEN ca IS NULL THEN v ELSE v + sqrt(ca) END, 6) AS fused FROM patches p LEFT JOIN ca ON site = user_id AND p.t = ca.t""")


def auto_contrast(spark, sf_dir):
    f = I.field(spark, sf_dir)
    lim = f.groupBy("t").agg(F.percentile("dx", F.array(F.lit(0.03), F.lit(0.97))).alias("p"))
    return f.join(lim, "t").select("t", "x", "y", S.r6(S.stretch(F.col("dx"), F.col("p")[0], F.col("p")[1])).alias("u"))


register("auto_contrast", auto_contrast, f"""
WITH {I.FIELD}, lim AS (SELECT t, quantile_cont(dx, 0.03) AS lo, quantile_cont(dx, 0.97) AS hi FROM field GROUP BY t)
SELECT t, x, y, round((CASE WHEN dx < lo THEN lo WHEN dx > hi THEN hi ELSE dx END - lo) / (hi - lo + 1e-8), 6) AS u FROM field JOIN lim USING (t)""")


def normalize_255(spark, sf_dir):
    p = I.patches(spark, sf_dir)
    lim = p.groupBy("site").agg(F.percentile("v", F.array(F.lit(0.03), F.lit(0.99))).alias("p"))
    return p.join(lim, "site").select("site", "t", S.r6(S.stretch(F.col("v"), F.col("p")[0], F.col("p")[1], 255.0)).alias("level"))


register("normalize_255", normalize_255, f"""
WITH {I.PATCHES}, lim AS (SELECT site, quantile_cont(v, 0.03) AS lo, quantile_cont(v, 0.99) AS hi FROM patches GROUP BY site)
SELECT site, t, round((CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END - lo) / (hi - lo + 1e-8) * 255, 6) AS level FROM patches JOIN lim USING (site)""")


def restandardize(spark, sf_dir):
    f = I.field(spark, sf_dir)
    m = f.groupBy("t").agg(F.avg("dx").alias("m"), F.stddev_pop("dx").alias("s"))
    return f.join(m.where("s > 0"), "t").select("t", "x", "y", S.r6((F.col("dx") - F.col("m")) / F.col("s") * 10 + 100).alias("v"))


register("restandardize", restandardize, f"""
WITH {I.FIELD}, m AS (SELECT t, avg(dx) AS m, stddev_pop(dx) AS s FROM field GROUP BY t)
SELECT t, x, y, round((dx - m) / s * 10 + 100, 6) AS v FROM field JOIN m USING (t) WHERE s > 0""")


def robust_mean_std(spark, sf_dir):
    """Mean and deviation of each site's days up to its 95th percentile, whose two neighbours are found by rank."""
    w = I.over("site")
    p = I.patches(spark, sf_dir).withColumn("k", F.row_number().over(w.orderBy("v")) - 1).withColumn("at", F.lit(0.95) * (F.count("*").over(w) - 1))
    lo, hi = (F.max(F.when(F.col("k") == place, F.col("v"))).over(w) for place in (F.floor("at"), F.ceil("at")))
    p = p.withColumn("lo", lo).withColumn("hi", hi)
    low = p.where(F.col("v") <= F.when(F.floor("at") == F.ceil("at"), F.col("lo")).otherwise(S.between(F.col("lo"), F.col("hi"), F.col("at") - F.floor("at"))))
    return low.groupBy("site").agg(S.r6(F.avg("v")).alias("mean"), S.r6(F.stddev_pop("v")).alias("std"), F.count("*").alias("n"))


register("robust_mean_std", robust_mean_std, f"""
WITH {I.PATCHES}, lim AS (SELECT site, quantile_cont(v, 0.95) AS hi FROM patches GROUP BY site)
SELECT site, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM patches JOIN lim USING (site) WHERE v <= hi GROUP BY site""")


def index_to_subscripts(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    r, c, k = S.subscripts(F.col("o_orderkey"), 40, 25)
    nx, ny = S.clamp(c + F.lit(3), 0, 24), S.clamp(r - F.lit(2), 0, 39)
    return o.select("o_orderkey", r.alias("row"), c.alias("col"), k.alias("plane"), nx.cast("long").alias("col_to"), ny.cast("long").alias("row_to"))


register("index_to_subscripts", index_to_subscripts, """
SELECT o_orderkey, (o_orderkey // 25) % 40 AS "row", o_orderkey % 25 AS col, o_orderkey // 1000 AS plane,
  least(greatest(o_orderkey % 25 + 3, 0), 24) AS col_to, least(greatest((o_orderkey // 25) % 40 - 2, 0), 39) AS row_to FROM orders""")


def determinants(spark, sf_dir):
    f = I.field(spark, sf_dir).groupBy("t").agg(*(F.avg(e).alias(n) for e, n in ((F.col("dx") * F.col("dx"), "xx"), (F.col("dy") * F.col("dy"), "yy"), (F.col("dx") * F.col("dy"), "xy"), (F.col("dx"), "xz"), (F.col("dy"), "yz"))))
    c = [F.col(n) for n in ("xx", "yy", "xy", "xz", "yz")]
    return f.select("t", F.round(S.det2(c[0], c[2], c[2], c[1]), 3).alias("det2"), F.round(S.det3_symmetric(c[0], c[1], F.lit(1.0), c[2], c[3], c[4]), 3).alias("det3"))


register("determinants", determinants, f"""
WITH {I.FIELD}, m AS (SELECT t, avg(dx*dx) AS xx, avg(dy*dy) AS yy, avg(dx*dy) AS xy, avg(dx) AS xz, avg(dy) AS yz FROM field GROUP BY t)
SELECT t, round(xx*yy - xy*xy, 3) AS det2, round(xx*(yy - yz*yz) - xy*(xy - yz*xz) + xz*(xy*yz - yy*xz), 3) AS det3 FROM m""")


def hann_weights(spark, sf_dir):
    c = I.cells(spark, sf_dir)
    return c.select("x", "y", S.r6(F.greatest(S.hann(F.col("x"), 40) * S.hann(F.col("y"), 25), F.lit(1e-3))).alias("w"))


register("hann_weights", hann_weights, f"""
WITH {I.CELLS} SELECT x, y, round(greatest(0.25 * (1 - cos(2 * pi() * x / 39)) * (1 - cos(2 * pi() * y / 24)), 1e-3), 6) AS w FROM cells""")


def control_grid(spark, sf_dir):
    size = I.cells(spark, sf_dir).agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    x = size.select("my", F.explode(F.sequence(F.lit(3).cast("long"), F.col("mx") - 1, F.lit(7).cast("long"))).alias("x"))
    g = x.select("x", F.explode(F.sequence(F.lit(3).cast("long"), F.col("my") - 1, F.lit(7).cast("long"))).alias("y"))
    return g.select("x", "y", ((F.col("x") - 3) / 7).cast("long").alias("cx"), ((F.col("y") - 3) / 7).cast("long").alias("cy"))


register("control_grid", control_grid, f"""
WITH {I.CELLS}, s AS (SELECT max(x) AS mx, max(y) AS my FROM cells), a AS (SELECT unnest(range(3, mx, 7)) AS x, my FROM s)
SELECT x, y, (x - 3) // 7 AS cx, (y - 3) // 7 AS cy FROM (SELECT x, unnest(range(3, my, 7)) AS y FROM a)""")


def softmax_by_label(spark, sf_dir):
    p = I.pixels(spark, sf_dir).groupBy("label", "slice").agg(F.sum("v").alias("s"))
    w = I.over("label")
    e = p.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("label", "slice", S.r6(F.col("e") / (F.sum("e").over(w) + 1e-8)).alias("p"))


register("softmax_by_label", softmax_by_label, f"""
WITH {I.PIXELS}, s AS (SELECT label, slice, sum(v) AS s FROM pixels GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label)) AS e FROM s)
SELECT label, slice, round(e / (sum(e) OVER (PARTITION BY label) + 1e-8), 6) AS p FROM e""")


def unit_field(spark, sf_dir):
    f = I.field(spark, sf_dir)
    n = F.greatest(S.norm(F.col("dx"), F.col("dy")), F.lit(1e-8))
    return f.select("t", "x", "y", S.r6(F.col("dx") / n).alias("ux"), S.r6(F.col("dy") / n).alias("uy"), S.r6(F.col("x") + F.col("dx")).alias("phase_x"), S.r6(F.col("y") + F.col("dy")).alias("phase_y"))


register("unit_field", unit_field, f"""
WITH {I.FIELD} SELECT t, x, y, round(dx / greatest(sqrt(dx*dx + dy*dy), 1e-8), 6) AS ux, round(dy / greatest(sqrt(dx*dx + dy*dy), 1e-8), 6) AS uy,
  round(x + dx, 6) AS phase_x, round(y + dy, 6) AS phase_y FROM field""")


def safe_numbers(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", S.safe_double(k, -1.0).alias("k"), S.safe_double(F.col("event_type"), 0.0).alias("type_number"))


register("safe_numbers", safe_numbers, """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS type_number FROM events""")


def normalized_traces(spark, sf_dir):
    p = I.patches(spark, sf_dir)
    w = I.over("site")
    top, energy, sd = F.max(F.abs("v")).over(w), F.sqrt(F.sum(F.col("v") * F.col("v")).over(w)), F.stddev_pop("v").over(w)
    z = F.when(sd < 1e-12, F.lit(0.0)).otherwise((F.col("v") - F.avg("v").over(w)) / sd)
    return p.select("site", "t", S.r6(F.when(top > 1e-12, F.col("v") / top).otherwise(0.0)).alias("by_max"), S.r6(F.when(energy > 1e-12, F.col("v") / energy).otherwise(0.0)).alias("by_energy"), S.r6(z).alias("z"))


register("normalized_traces", normalized_traces, f"""
WITH {I.PATCHES}, w AS (SELECT site, t, v, max(abs(v)) OVER s AS top, sqrt(sum(v*v) OVER s) AS energy, stddev_pop(v) OVER s AS sd, avg(v) OVER s AS m FROM patches WINDOW s AS (PARTITION BY site))
SELECT site, t, round(CASE WHEN top > 1e-12 THEN v / top ELSE 0.0 END, 6) AS by_max, round(CASE WHEN energy > 1e-12 THEN v / energy ELSE 0.0 END, 6) AS by_energy,
  round(CASE WHEN sd < 1e-12 THEN 0.0 ELSE (v - m) / sd END, 6) AS z FROM w""")


def query_masks(spark, sf_dir):
    c = I.cells(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    return c.select("x", "y", S.in_disc(x, y, 20, 12, 6).alias("in_disc"), S.in_box(x, y, 5, 5, 30, 20).alias("in_box"), ((x % 4 == 0) & (y % 4 == 0)).alias("on_stride"), ((x >= 3) & (x < 37) & (y >= 3) & (y < 22)).alias("inside"), S.r6(x / 39).alias("nx"), S.r6(y / 24).alias("ny"))


register("query_masks", query_masks, f"""
WITH {I.CELLS} SELECT x, y, (x-20)*(x-20) + (y-12)*(y-12) <= 36 AS in_disc, x >= 5 AND x < 30 AND y >= 5 AND y < 20 AS in_box,
  x % 4 = 0 AND y % 4 = 0 AS on_stride, x BETWEEN 3 AND 36 AND y BETWEEN 3 AND 21 AS inside, round(x / 39, 6) AS nx, round(y / 24, 6) AS ny FROM cells""")


def colour_levels(spark, sf_dir):
    """Levels of a 16-step table by rounding half to even; missing values take level 0."""
    u = auto_contrast(spark, sf_dir)
    i = F.coalesce(F.rint(F.col("u") * 15).cast("int"), F.lit(0))
    lut = F.array(*(F.lit(17 * k) for k in range(16)))
    return u.select("t", "x", "y", i.alias("level"), F.element_at(lut, i + 1).alias("grey"))


register("colour_levels", colour_levels, f"""
WITH {I.FIELD}, lim AS (SELECT t, quantile_cont(dx, 0.03) AS lo, quantile_cont(dx, 0.97) AS hi FROM field GROUP BY t),
u AS (SELECT t, x, y, round((CASE WHEN dx < lo THEN lo WHEN dx > hi THEN hi ELSE dx END - lo) / (hi - lo + 1e-8), 6) AS u FROM field JOIN lim USING (t))
SELECT t, x, y, coalesce(CAST(round_even(u * 15, 0) AS INT), 0) AS level, 17 * coalesce(CAST(round_even(u * 15, 0) AS INT), 0) AS grey FROM u""")


def contrast_limits(spark, sf_dir):
    """Percentile limits over finite values that are no fill; a flat slice widens to one; and the symmetric variant."""
    f = I.field(spark, sf_dir).where("dx <> -200")
    p = R.group_quantiles(f, ["t"], "dx", {"p01": 0.01, "p99": 0.99}).drop("n")
    p = p.join(R.group_quantiles(f.select("t", F.abs("dx").alias("size")), ["t"], "size", {"a": 0.99}).drop("n"), "t")
    lo, hi = F.col("p01"), F.col("p99")
    return p.select("t", S.r6(lo).alias("lo"), S.r6(F.when(hi > lo, hi).otherwise(lo + 1)).alias("hi"), S.r6(-F.col("a")).alias("sym_lo"), S.r6(F.col("a")).alias("sym_hi"))


register("contrast_limits", contrast_limits, f"""
WITH {I.FIELD}, p AS (SELECT t, quantile_cont(dx, 0.01) AS lo, quantile_cont(dx, 0.99) AS hi, quantile_cont(abs(dx), 0.99) AS a FROM field WHERE dx <> -200 GROUP BY t)
SELECT t, round(lo, 6) AS lo, round(CASE WHEN hi > lo THEN hi ELSE lo + 1 END, 6) AS hi, round(-a, 6) AS sym_lo, round(a, 6) AS sym_hi FROM p""")


def rank_percentiles(spark, sf_dir):
    """Percentiles by rank, floor(p (n - 1)), with no interpolation."""
    p = I.patches(spark, sf_dir)
    w = I.over("site")
    r = p.select("site", "v", F.row_number().over(w.orderBy("v", "t")).alias("k"), F.count("*").over(w).alias("n"))
    at = lambda q: F.max(F.when(F.col("k") == F.floor(q * (F.col("n") - 1)) + 1, F.col("v")))
    return r.groupBy("site").agg(S.r6(at(0.05)).alias("p05"), S.r6(at(0.95)).alias("p95"))


register("rank_percentiles", rank_percentiles, f"""
WITH {I.PATCHES}, r AS (SELECT site, v, row_number() OVER (PARTITION BY site ORDER BY v, t) AS k, count(*) OVER (PARTITION BY site) AS n FROM patches)
SELECT site, round(max(v) FILTER (k = floor(0.05 * (n - 1)) + 1), 6) AS p05, round(max(v) FILTER (k = floor(0.95 * (n - 1)) + 1), 6) AS p95 FROM r GROUP BY site""")
