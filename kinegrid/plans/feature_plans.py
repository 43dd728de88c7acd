"""Queries of features, references from blocks, guarded systems and correlations, and interval forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranks as R
from . import inputs as I
from .join_plans import initial_reference, order_frames, reference_frames
from .registry import oracle_sql, register
from .window_plans import resampled


def temporal_features(spark, sf_dir):
    """Each site's series at 16 points, at unit norm, with its steps; a series of zeros stays as it is."""
    a = resampled(spark, sf_dir).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("h"))
    norm = F.sqrt(F.aggregate("h", F.lit(0.0), lambda s, x: s + x * x))
    h = a.select("site", F.transform("h", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("h"))
    d = h.select("site", F.posexplode(F.transform("h", lambda x, i: F.struct(x.alias("h"), (x - F.get("h", F.greatest(i - 1, F.lit(0)))).alias("d")))).alias("i", "s"))
    return d.select("site", "i", S.r6(F.col("s.h")).alias("h"), S.r6(F.col("s.d")).alias("d"))


register("temporal_features", temporal_features, f"""
WITH r AS ({oracle_sql()['resampled']}), n AS (SELECT site, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY site)), 1e-12) AS h FROM r)
SELECT site, i, round(h, 6) AS h, round(h - coalesce(lag(h) OVER (PARTITION BY site ORDER BY i), h), 6) AS d FROM n""")


def block_reference(spark, sf_dir):
    """Each label's reference slice: the mean of its best correlated slice and that one's nearest, plus half the root of
    their mean square as the transformed second channel."""
    r = initial_reference(spark, sf_dir).select("label", F.explode(F.concat(F.array("slice"), F.col("nearest"))).alias("slice"))
    p = I.pixels(spark, sf_dir).join(r, ["label", "slice"])
    return p.groupBy("label", "p").agg(S.r6(F.avg("v") + 0.5 * F.sqrt(F.avg(F.col("v") * F.col("v")))).alias("v"))


register("block_reference", block_reference, f"""
WITH {I.PIXELS}, i AS ({oracle_sql()['initial_reference']}), s AS (SELECT label, unnest(list_prepend(slice, nearest)) AS slice FROM i)
SELECT label, p, round(avg(v) + 0.5 * sqrt(avg(v * v)), 6) AS v FROM pixels JOIN s USING (label, slice) GROUP BY label, p""")


def frame_rmse(spark, sf_dir):
    """Mean squared error of each month's field against the month before, its root, and that over the field's spread."""
    f = I.field(spark, sf_dir).select("t", "x", "y", "dx")
    j = f.join(f.select((F.col("t") + 1).alias("t"), "x", "y", F.col("dx").alias("g")), ["t", "x", "y"])
    e = j.groupBy("t").agg(F.avg((F.col("dx") - F.col("g")) * (F.col("dx") - F.col("g"))).alias("mse"), F.stddev_pop("dx").alias("sd"))
    return e.select("t", S.r6(F.col("mse")).alias("mse"), S.r6(F.sqrt("mse")).alias("rmse"), S.r6(F.try_divide(F.sqrt("mse"), "sd")).alias("relative"))


register("frame_rmse", frame_rmse, f"""
WITH {I.FIELD}, e AS (SELECT a.t, avg((a.dx - b.dx) * (a.dx - b.dx)) AS mse, stddev_pop(a.dx) AS sd FROM field a JOIN field b ON a.t = b.t + 1 AND a.x = b.x AND a.y = b.y GROUP BY a.t)
SELECT t, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(CASE WHEN sd <> 0 THEN sqrt(mse) / sd END, 6) AS relative FROM e""")


def solved_systems(spark, sf_dir):
    """Each cell's 2 x 2 normal equations in closed form; a nearly singular system has the solution 0."""
    f = I.field(spark, sf_dir)
    of = lambda e: F.sum(e)
    m = f.groupBy("x", "y").agg(of(F.col("dx") * F.col("dx")).alias("a"), of(F.col("dx") * F.col("dy")).alias("b"), of(F.col("dy") * F.col("dy")).alias("c"), of("dx").alias("p"), of("dy").alias("q"))
    det = S.det2(F.col("a"), F.col("b"), F.col("b"), F.col("c"))
    ok = F.abs(det) > 1e-6 * F.col("a") * F.col("c")
    u, v = (F.when(ok, e / det).otherwise(0.0) for e in (S.det2(F.col("p"), F.col("b"), F.col("q"), F.col("c")), S.det2(F.col("a"), F.col("p"), F.col("b"), F.col("q"))))
    return m.select("x", "y", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"), (~ok).alias("singular"))


register("solved_systems", solved_systems, f"""
WITH {I.FIELD}, m AS (SELECT x, y, sum(dx*dx) AS a, sum(dx*dy) AS b, sum(dy*dy) AS c, sum(dx) AS p, sum(dy) AS q FROM field GROUP BY ALL), d AS (SELECT *, a*c - b*b AS det, abs(a*c - b*b) > 1e-6 * a * c AS ok FROM m)
SELECT x, y, round(CASE WHEN ok THEN (p*c - b*q) / det ELSE 0.0 END, 5) AS u, round(CASE WHEN ok THEN (a*q - p*b) / det ELSE 0.0 END, 5) AS v, NOT ok AS singular FROM d""")


def safe_correlations(spark, sf_dir):
    """Correlation of each site's series with its clicks; where one is flat the cosine, 0 where one is zero."""
    b = I.patches(spark, sf_dir, "click").select("site", "t", F.col("v").alias("b"))
    j = I.patches(spark, sf_dir).select("site", "t", F.col("v").alias("a")).join(b, ["site", "t"])
    m = j.groupBy("site").agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for e, k in ((F.col("a"), "sa"), (F.col("b"), "sb"), (F.col("a") * F.col("a"), "saa"), (F.col("b") * F.col("b"), "sbb"), (F.col("a") * F.col("b"), "sab"))))
    n = F.col("n")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    flat = (va <= 1e-9 * n * F.col("saa")) | (vb <= 1e-9 * n * F.col("sbb"))
    r = F.when(~flat, (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)).otherwise(F.coalesce(F.try_divide("sab", F.sqrt(F.col("saa") * F.col("sbb"))), F.lit(0.0)))
    return m.select("site", F.round(r, 5).alias("r"), flat.alias("flat"))


register("safe_correlations", safe_correlations, f"""
WITH {I.PATCHES}, b AS (SELECT p.site, p.t, p.v AS a, coalesce(d.v, 0.0) AS b FROM patches p LEFT JOIN (SELECT user_id, t, sum(value) AS v FROM ev WHERE event_type = 'click' GROUP BY ALL) d ON d.user_id = p.site AND d.t = p.t),
m AS (SELECT site, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a*a) AS saa, sum(b*b) AS sbb, sum(a*b) AS sab FROM b GROUP BY site),
f AS (SELECT *, n*saa - sa*sa AS va, n*sbb - sb*sb AS vb, n*saa - sa*sa <= 1e-9*n*saa OR n*sbb - sb*sb <= 1e-9*n*sbb AS flat FROM m)
SELECT site, round(CASE WHEN NOT flat THEN (n*sab - sa*sb) / sqrt(va*vb) WHEN saa*sbb > 0 THEN sab / sqrt(saa*sbb) ELSE 0.0 END, 5) AS r, flat FROM f""")


def hyperstack_index(spark, sf_dir):
    """Images of each channel family of every frame, with the reference that covers the frame, of several the one that begins last.

    The reference is chosen once for each frame, before the orders that fold onto it meet it; the join is told not to broadcast a side."""
    begin = F.regexp_extract("file", r"vol_ref_(\d{6,})_", 1).cast("long")
    one = reference_frames(spark, sf_dir).groupBy("frame").agg(F.max_by("file", begin).alias("reference"))
    o = order_frames(spark, sf_dir).select("frame", F.substring("o_orderpriority", 1, 1).alias("channel"))
    return o.join(one.hint("merge"), "frame").groupBy("frame", "reference", "channel").agg(F.count("*").alias("images"))


register("hyperstack_index", hyperstack_index, f"""
WITH r AS ({oracle_sql()['reference_intervals']}), b AS (SELECT o_orderkey, min(frame) AS frame, arg_max(file, CAST(regexp_extract(file, 'vol_ref_(\\d+)_', 1) AS BIGINT)) AS reference FROM r GROUP BY o_orderkey),
o AS (SELECT frame, reference, substr(o_orderpriority, 1, 1) AS channel FROM orders JOIN b USING (o_orderkey))
SELECT frame, reference, channel, count(*) AS images FROM o GROUP BY ALL""")


def interval_forms(spark, sf_dir):
    """Which convention an interval's end follows, told by its length, and the inclusive end."""
    li = I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))
    o = I.table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    s, e = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).cast("long"), F.col("last") + F.col("o_orderkey") % 3 - 1
    rows = o.select("o_orderkey", s.alias("t0"), (s + e).alias("end"), "n")
    form = F.when(F.col("end") - F.col("t0") + 1 == F.col("n"), "inclusive").when(F.col("end") - F.col("t0") == F.col("n"), "exclusive").otherwise("by length")
    return rows.select("o_orderkey", "t0", form.alias("form"), (F.col("t0") + F.col("n") - 1).alias("t1"))


register("interval_forms", interval_forms, """
WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t0, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + last + o_orderkey % 3 - 1 AS e, n FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, t0, CASE WHEN e - t0 + 1 = n THEN 'inclusive' WHEN e - t0 = n THEN 'exclusive' ELSE 'by length' END AS form, t0 + n - 1 AS t1 FROM r""")


def plane_mapped(spark, sf_dir):
    """The mean volume's intensities mapped onto the last year's by five quantiles learnt on planes 1 to 5, applied to all
    planes; of each plane the mean after the map and the part above the target's median, the rebuilt mask."""
    v = I.volume(spark, sf_dir)
    last = v.agg(F.max("t")).first()[0]  # one number
    mean = v.groupBy("x", "y", "z").agg(F.avg("v").alias("v"))
    q = [0.0, 0.25, 0.5, 0.75, 1.0]
    source = R.quantiles(mean.where("z between 1 and 5"), "v", q)
    target = R.quantiles(v.where((F.col("t") == last) & F.col("z").between(1, 5)), "v", q)
    c = S.clamp(F.col("v"), source[0], source[-1])
    mapped = F.lit(target[-1])
    for k in reversed(range(4)):
        part = (c - source[k]) / max(source[k + 1] - source[k], 1e-12)
        mapped = F.when(c < source[k + 1], target[k] + part * (target[k + 1] - target[k])).otherwise(mapped)
    m = mean.select("z", mapped.alias("m"))
    return m.groupBy("z").agg(F.round(F.avg("m"), 5).alias("mean"), S.r6(F.avg((F.col("m") > target[2]).cast("int"))).alias("masked"))


register("plane_mapped", plane_mapped, f"""
WITH {I.VOLUME}, mean AS (SELECT x, y, z, avg(v) AS v FROM volume GROUP BY ALL), k AS (SELECT unnest(range(0, 5)) AS k),
s AS (SELECT k, quantile_cont(v, [0.0, 0.25, 0.5, 0.75, 1.0])[k + 1] AS s FROM mean, k WHERE z BETWEEN 1 AND 5 GROUP BY k), g AS (SELECT k, quantile_cont(v, [0.0, 0.25, 0.5, 0.75, 1.0])[k + 1] AS g FROM volume, k WHERE z BETWEEN 1 AND 5 AND t = (SELECT max(t) FROM volume) GROUP BY k),
a AS (SELECT k, s AS lo, lead(s) OVER (ORDER BY k) AS hi, g AS glo, lead(g) OVER (ORDER BY k) AS ghi FROM s JOIN g USING (k)),
c AS (SELECT z, greatest((SELECT min(lo) FROM a), least((SELECT max(lo) FROM a), v)) AS c FROM mean),
m AS (SELECT z, CASE WHEN hi IS NULL THEN glo ELSE glo + (c - lo) / greatest(hi - lo, 1e-12) * (ghi - glo) END AS m FROM c JOIN a ON c >= lo AND (hi IS NULL OR c < hi))
SELECT z, round(avg(m), 5) AS mean, round(avg(CAST(m > (SELECT glo FROM a WHERE k = 2) AS INT)), 6) AS masked FROM m GROUP BY z""")


def run_geometry(spark, sf_dir):
    """Of each artifact family its first and last frame, the frames that are there and those that lack in between."""
    p = I.table(spark, sf_dir, "pages").select((F.col("page_id") % 100).alias("frame"), F.when(F.col("page_id") % 3 == 0, "field").when(F.col("page_id") % 3 == 1, "raw").otherwise("mask").alias("kind"))
    r = p.groupBy("kind").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count_distinct("frame").alias("frames"))
    return r.select("kind", "first", "last", "frames", (F.col("last") - F.col("first") + 1 - F.col("frames")).alias("missing"))


register("run_geometry", run_geometry, """
WITH p AS (SELECT page_id % 100 AS frame, CASE page_id % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'raw' ELSE 'mask' END AS kind FROM pages)
SELECT kind, min(frame) AS first, max(frame) AS last, count(DISTINCT frame) AS frames, max(frame) - min(frame) + 1 - count(DISTINCT frame) AS missing FROM p GROUP BY kind""")
