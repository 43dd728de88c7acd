"""Queries over ordered series: motion units, events, interval unions, coupling, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grids as G
from ..operators import windows as W
from . import inputs as I
from .registry import register

REST = """
med AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY site ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM patches),
mad AS (SELECT *, quantile_cont(abs(v - med), 0.5) OVER (PARTITION BY site ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mad FROM med),
rest AS (SELECT *, med + 2.0 * 1.4826 * mad AS rest FROM mad)"""
UNITS = f"""
{REST},
a1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY site ORDER BY t) <= 2 THEN 0 ELSE 1 END AS fresh FROM rest WHERE v > rest),
a2 AS (SELECT *, sum(fresh) OVER (PARTITION BY site ORDER BY t) AS run FROM a1),
a3 AS (SELECT site, greatest(0, min(t) - 1) AS s, least(max(frames) - 1, max(t) + 1) AS e FROM a2 GROUP BY site, run),
a4 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY site ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM a3),
a5 AS (SELECT *, sum(fresh) OVER (PARTITION BY site ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM a4),
units AS (SELECT site, min(s) AS t0, max(e) AS t1 FROM a5 GROUP BY site, run)"""


def units(spark, sf_dir):
    p = I.patches(spark, sf_dir)
    u = W.motion_units(p, ["site"], "t", "v", F.col("frames"))
    return u.select("site", F.col("t0").cast("long").alias("t0"), F.col("t1").cast("long").alias("t1"))


def motion_units(spark, sf_dir):
    u = units(spark, sf_dir)
    return u.select("site", (F.col("site") % I.WIDTH).alias("x"), F.floor(F.col("site") / I.WIDTH).alias("y"), "t0", "t1", (F.col("t1") - F.col("t0") + 1).alias("frames"))


register("motion_units", motion_units, f"""
WITH {I.PATCHES}, {UNITS} SELECT site, site % 15 AS x, site // 15 AS y, t0, t1, t1 - t0 + 1 AS frames FROM units""")


def rest_threshold(spark, sf_dir):
    return W.rolling_rest(I.patches(spark, sf_dir), ["site"], "t", "v", 5, 2.0).select("site", "t", S.r6(F.col("rest")).alias("rest"), (F.col("v") > F.col("rest")).alias("active"))


register("rest_threshold", rest_threshold, f"WITH {I.PATCHES}, {REST} SELECT site, t, round(rest, 6) AS rest, v > rest AS active FROM rest")


def patch_delta(spark, sf_dir):
    p = I.patches(spark, sf_dir)
    w = I.over("site").orderBy("t")
    return p.withColumn("d", F.col("v") - F.lag("v").over(w)).where("d is not null").select("site", "t", S.r6(F.col("d")).alias("d"))


register("patch_delta", patch_delta, f"""
WITH {I.PATCHES}, d AS (SELECT site, t, v - lag(v) OVER (PARTITION BY site ORDER BY t) AS d FROM patches) SELECT site, t, round(d, 6) AS d FROM d WHERE d IS NOT NULL""")


def closed_runs(spark, sf_dir):
    d = I.daily(spark, sf_dir, "event_type")
    return W.islands(d, ["user_id", "event_type"], "t", 1).select("user_id", "event_type", "t0", "t1", "n")


register("closed_runs", closed_runs, """
WITH d AS (SELECT DISTINCT user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) <= 2 THEN 0 ELSE 1 END AS fresh FROM d),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY t) AS run FROM g)
SELECT user_id, event_type, min(t) AS t0, max(t) AS t1, count(*) AS n FROM r GROUP BY user_id, event_type, run""")


def mad_events(spark, sf_dir):
    e = W.mad_events(I.patches(spark, sf_dir), ["site"], "t", "v", 3.0, 1, 1)
    return e.select("site", "t0", "t1", "n", "peak_t", S.r6(F.col("peak")).alias("peak"))


MAD_EVENTS = """
m1 AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY site) AS med, stddev_pop(v) OVER (PARTITION BY site) AS sd FROM patches),
m2 AS (SELECT *, 1.4826 * quantile_cont(abs(v - med), 0.5) OVER (PARTITION BY site) AS mad FROM m1),
m3 AS (SELECT * FROM m2 WHERE v > med + 3.0 * CASE WHEN mad > 0 THEN mad ELSE sd END),
m4 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY site ORDER BY t) <= 2 THEN 0 ELSE 1 END AS fresh FROM m3),
m5 AS (SELECT *, sum(fresh) OVER (PARTITION BY site ORDER BY t) AS run FROM m4),
mad_events AS (SELECT site, min(t) AS t0, max(t) AS t1, count(*) AS n, arg_max(t, (v, -t)) AS peak_t, max(v) AS peak FROM m5 GROUP BY site, run)"""
register("mad_events", mad_events, f"WITH {I.PATCHES}, {MAD_EVENTS} SELECT site, t0, t1, n, peak_t, round(peak, 6) AS peak FROM mad_events")


def moving_average(spark, sf_dir):
    return W.smooth(I.patches(spark, sf_dir), ["site"], "t", "v", 1, "m").select("site", "t", S.r6(F.col("m")).alias("m"))


register("moving_average", moving_average, f"""
WITH {I.PATCHES} SELECT site, t, round(sum(v) OVER (PARTITION BY site ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS m FROM patches""")


def relative_change(spark, sf_dir):
    return W.dff(I.patches(spark, sf_dir), ["site"], "v").select("site", "t", F.round("dff", 3).alias("dff"))


register("relative_change", relative_change, f"""
WITH {I.PATCHES}, b AS (SELECT *, quantile_cont(v, 0.2) OVER (PARTITION BY site) AS b FROM patches) SELECT site, t, round((v - b) / (abs(b) + 1e-6), 3) AS dff FROM b""")


def active_chunks(spark, sf_dir):
    """Change, moving average, robust threshold, gaps closed, short runs dropped: one sort by site serves all."""
    p = W.smooth(W.dff(I.patches(spark, sf_dir), ["site"], "v", eps=1.0), ["site"], "t", "dff", 1, "m")
    e = W.mad_events(p.withColumn("m", F.round("m", 9)), ["site"], "t", "m", 2.0, 1, 2)
    return e.select("site", "t0", "t1", "n")


register("active_chunks", active_chunks, f"""
WITH {I.PATCHES}, b AS (SELECT *, quantile_cont(v, 0.2) OVER (PARTITION BY site) AS b FROM patches),
s AS (SELECT site, t, round(sum((v - b) / (abs(b) + 1.0)) OVER (PARTITION BY site ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 9) AS v FROM b),
m1 AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY site) AS med, stddev_pop(v) OVER (PARTITION BY site) AS sd FROM s),
m2 AS (SELECT *, 1.4826 * quantile_cont(abs(v - med), 0.5) OVER (PARTITION BY site) AS mad FROM m1),
m3 AS (SELECT * FROM m2 WHERE v > med + 2.0 * CASE WHEN mad > 0 THEN mad ELSE sd END),
m4 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY site ORDER BY t) <= 2 THEN 0 ELSE 1 END AS fresh FROM m3),
m5 AS (SELECT *, sum(fresh) OVER (PARTITION BY site ORDER BY t) AS run FROM m4)
SELECT site, min(t) AS t0, max(t) AS t1, count(*) AS n FROM m5 GROUP BY site, run HAVING max(t) - min(t) + 1 >= 2""")


def merged_intervals(spark, sf_dir):
    o, li = I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "lineitem")
    ship = li.groupBy("l_orderkey").agg(F.max(F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01"))).alias("e"))
    spans = o.select("o_custkey", "o_orderkey", F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).alias("s")).join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    spans = spans.select("o_custkey", F.least("s", "e").alias("s"), F.greatest("s", "e").alias("e"))
    return W.union_intervals(spans, ["o_custkey"], "s", "e", 1).select("o_custkey", "t0", "t1", "n")


register("merged_intervals", merged_intervals, """
WITH ship AS (SELECT l_orderkey, max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS e FROM lineitem GROUP BY 1),
i AS (SELECT o_custkey, least(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)), e) AS s, greatest(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)), e) AS e FROM orders JOIN ship ON o_orderkey = l_orderkey),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS fresh FROM i),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT o_custkey, min(s) AS t0, max(e) AS t1, count(*) AS n FROM r GROUP BY o_custkey, run""")


def activation_traces(spark, sf_dir):
    """Unit activations on the whole time axis: values inside a unit, normalised by its largest, zero elsewhere."""
    p, u = I.patches(spark, sf_dir), units(spark, sf_dir)
    inside = u.select("site", "t0", F.explode(F.sequence("t0", "t1")).alias("t")).join(p.select("site", F.col("t").cast("long").alias("t"), "v"), ["site", "t"])
    top = F.max(F.abs("v")).over(I.over("site", "t0"))
    h = inside.withColumn("h", F.when(top > 0, F.col("v") / top).otherwise(0.0)).select("site", "t", "h")
    return p.select("site", F.col("t").cast("long").alias("t")).join(h, ["site", "t"], "left").select("site", "t", S.r6(F.coalesce("h", F.lit(0.0))).alias("h"))


TRACES = """
ins AS (SELECT u.site, u.t0, p.t, p.v FROM units u JOIN patches p ON p.site = u.site AND p.t BETWEEN u.t0 AND u.t1),
tr AS (SELECT site, t, CASE WHEN max(abs(v)) OVER (PARTITION BY site, t0) > 0 THEN v / max(abs(v)) OVER (PARTITION BY site, t0) ELSE 0.0 END AS h FROM ins),
traces AS (SELECT p.site, p.t, coalesce(h, 0.0) AS h FROM patches p LEFT JOIN tr ON tr.site = p.site AND tr.t = p.t)"""
register("activation_traces", activation_traces, f"WITH {I.PATCHES}, {UNITS}, {TRACES} SELECT site, t, round(h, 6) AS h FROM traces")


def class_traces(spark, sf_dir):
    """Strength-weighted mean trace of each class of sites."""
    tr = activation_traces(spark, sf_dir).withColumn("class", F.when(F.col("site") % 3 == 0, "local").when(F.col("site") % 3 == 1, "mixed").otherwise("global"))
    w = I.patches(spark, sf_dir).groupBy("site").agg(F.sum("v").alias("w"))
    w = w.select("site", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).alias("w"))
    return tr.join(w, "site").groupBy("class", "t").agg(F.round(F.sum(F.col("w") * F.col("h")) / F.sum("w"), 4).alias("h"))


register("class_traces", class_traces, f"""
WITH {I.PATCHES}, {UNITS}, {TRACES}, w AS (SELECT site, CASE WHEN sum(v) > 0 THEN sum(v) ELSE 1.0 END AS w FROM patches GROUP BY site)
SELECT CASE site % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'mixed' ELSE 'global' END AS class, t, round(sum(w * round(h, 6)) / sum(w), 4) AS h FROM traces JOIN w USING (site) GROUP BY ALL""")


def baseline_probability(spark, sf_dir):
    p = I.patches(spark, sf_dir, "click").withColumn("active", F.col("v") > 0)
    return W.window_probability(p, ["site"], "t", "active", 5).select("site", S.r6(F.col("prob")).alias("prob"))


CLICKS = """
clicks AS (SELECT p.site, p.t, p.frames, coalesce(d.v, 0.0) > 0 AS active FROM patches p LEFT JOIN (SELECT user_id, t, sum(value) AS v FROM ev WHERE event_type = 'click' GROUP BY ALL) d ON d.user_id = p.site AND d.t = p.t)"""
register("baseline_probability", baseline_probability, f"""
WITH {I.PATCHES}, {CLICKS}, a AS (SELECT site, max(CAST(active AS INT)) OVER w AS hit, count(*) OVER w AS n FROM clicks WINDOW w AS (PARTITION BY site ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT site, round(avg(hit), 6) AS prob FROM a WHERE n = 5 GROUP BY site""")


def onsets(spark, sf_dir):
    """(roi, start): first days of the merged active intervals of each region of interest, a row of the site grid."""
    u = units(spark, sf_dir).select(F.floor(F.col("site") / I.WIDTH).alias("roi"), "t0", "t1").distinct()
    return W.union_intervals(u, ["roi"], "t0", "t1", 0).select("roi", F.col("t0").alias("start"))


ONSETS = """
o1 AS (SELECT site // 15 AS roi, t0, t1, CASE WHEN t0 <= max(t1) OVER (PARTITION BY site // 15 ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM units),
o2 AS (SELECT *, sum(fresh) OVER (PARTITION BY roi ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS run FROM o1),
onsets AS (SELECT roi, min(t0) AS start FROM o2 GROUP BY roi, run)"""


def clicked(spark, sf_dir):
    """(site, roi, t, frames, active) of the second channel."""
    return I.patches(spark, sf_dir, "click").select("site", F.floor(F.col("site") / I.WIDTH).alias("roi"), "t", "frames", (F.col("v") > 0).alias("active"))


def coupled(spark, sf_dir, lags):
    """Of each site the lag whose windows after the onsets of its region are hit most above the baseline; ``prob`` unrounded."""
    p = clicked(spark, sf_dir)
    frames = I.span(spark, sf_dir)
    lag = F.explode(F.array(*(F.lit(k) for k in lags))).alias("lag")
    starts = onsets(spark, sf_dir).select("roi", "start", lag).select("roi", F.col("lag").cast("long").alias("lag"), (F.col("start") + F.col("lag")).alias("start"))
    hit = W.hit_rate(p, starts.where(f"start >= 0 and start < {frames}"), ["site"], "t", "active", 3, frames, ["roi"], ["lag"])
    base = W.window_probability(p, ["site"], "t", "active", 3)
    d = hit.join(base, "site").withColumn("dependency", F.round(F.col("hits") / F.col("windows") - F.col("prob"), 6))
    return G.best(d, ["site"], F.desc("dependency"), "lag").select("site", "lag", "windows", "hits", "dependency", "prob")


def lag_coupling(spark, sf_dir):
    """Best lag of each site: hit rate of windows after the onsets against the baseline; the earliest lag wins ties."""
    return coupled(spark, sf_dir, range(6)).drop("prob")


def coupled_sql(lags):
    return f"""
WITH {I.PATCHES}, {CLICKS}, {UNITS}, {ONSETS},
sp AS (SELECT roi, l AS lag, start + l AS s, least((SELECT max(frames) FROM patches), start + l + 3) AS e FROM onsets, (SELECT unnest({lags}) AS l) WHERE start + l >= 0),
h AS (SELECT c.site, sp.lag, sp.s, sp.e, max(CAST(active AS INT)) AS hit FROM sp JOIN clicks c ON c.site // 15 = sp.roi AND c.t >= sp.s AND c.t < sp.e WHERE sp.s < sp.e GROUP BY ALL),
r AS (SELECT site, lag, count(*) AS windows, CAST(sum(hit) AS BIGINT) AS hits FROM h GROUP BY ALL),
b AS (SELECT site, avg(hit) AS prob FROM (SELECT site, max(CAST(active AS INT)) OVER w AS hit, count(*) OVER w AS n FROM clicks WINDOW w AS (PARTITION BY site ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3 GROUP BY site),
d AS (SELECT r.*, prob, round(hits / windows - prob, 6) AS dependency FROM r JOIN b USING (site)),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY dependency DESC, lag) = 1)"""


register("lag_coupling", lag_coupling, f"{coupled_sql('range(0, 6)')} SELECT site, lag, windows, hits, dependency FROM best")


def lags_around(spark, sf_dir):
    """The same with lags on both sides of the onsets."""
    return coupled(spark, sf_dir, range(-4, 5)).drop("prob")


register("lags_around", lags_around, f"{coupled_sql('range(-4, 5)')} SELECT site, lag, windows, hits, dependency FROM best")


def coupling_pvalues(spark, sf_dir):
    """Binomial tail of the best lag's hits at the baseline rate, a pass over a site's own windows."""
    d = coupled(spark, sf_dir, range(6))
    return d.select("site", "lag", "windows", "hits", "dependency", S.r6(S.binomial_tail(F.col("hits"), F.col("windows"), F.col("prob"))).alias("p_value"))


register("coupling_pvalues", coupling_pvalues, f"""{coupled_sql('range(0, 6)')},
tail AS (SELECT site, sum(exp(lgamma(windows + 1) - lgamma(i + 1) - lgamma(windows - i + 1) + i * ln(prob) + (windows - i) * ln(1 - prob))) AS tail FROM (SELECT *, unnest(range(CAST(hits AS BIGINT), windows + 1)) AS i FROM best WHERE prob > 0 AND prob < 1) GROUP BY site)
SELECT site, lag, windows, hits, dependency, round(CASE WHEN hits <= 0 THEN 1.0 WHEN prob <= 0 THEN 0.0 WHEN prob >= 1 THEN 1.0 ELSE least(1.0, tail) END, 6) AS p_value FROM best LEFT JOIN tail USING (site)""")


def lag_correlation(spark, sf_dir):
    """Correlation of each site's trace with its clicks at lags 0..5, from moments; flat series have none."""
    a = I.patches(spark, sf_dir).select("site", "t", F.col("v").alias("a"))
    b = I.patches(spark, sf_dir, "click").select("site", "t", F.col("v").alias("b"))
    lagged = a.select("site", "a", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(k.alias("lag"), (F.col("t") + k).alias("t")))).alias("o")).select("site", "a", "o.lag", "o.t")
    m = lagged.join(b, ["site", "t"]).groupBy("site", "lag").agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for e, k in ((F.col("a"), "sa"), (F.col("b"), "sb"), (F.col("a") * F.col("a"), "saa"), (F.col("b") * F.col("b"), "sbb"), (F.col("a") * F.col("b"), "sab"))))
    n = F.col("n")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    return m.where((va > 1e-6) & (vb > 1e-6)).select("site", "lag", F.round((n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb), 5).alias("r"))


register("lag_correlation", lag_correlation, f"""
WITH {I.PATCHES}, b AS (SELECT p.site, p.t, coalesce(d.v, 0.0) AS b FROM patches p LEFT JOIN (SELECT user_id, t, sum(value) AS v FROM ev WHERE event_type = 'click' GROUP BY ALL) d ON d.user_id = p.site AND d.t = p.t),
m AS (SELECT a.site, l.lag, count(*) AS n, sum(v) AS sa, sum(b) AS sb, sum(v*v) AS saa, sum(b*b) AS sbb, sum(v*b) AS sab FROM patches a, (SELECT unnest(range(0, 6)) AS lag) l, b WHERE b.site = a.site AND b.t = a.t + l.lag GROUP BY ALL)
SELECT site, lag, round((n*sab - sa*sb) / sqrt((n*saa - sa*sa) * (n*sbb - sb*sb)), 5) AS r FROM m WHERE n*saa - sa*sa > 1e-6 AND n*sbb - sb*sb > 1e-6""")


def resampled(spark, sf_dir):
    """Each site's series at 16 evenly spaced points, linear between frames."""
    a = I.patches(spark, sf_dir).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("a"))
    x = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i * (F.size("a") - 1) / 15.0)
    at = a.select("site", "a", F.posexplode(x).alias("i", "x"))
    lo = F.floor("x").cast("int")
    value = lambda k: F.get("a", F.least(k, F.size("a") - 1))["v"]
    f = F.col("x") - F.floor("x")
    return at.select("site", "i", S.r6(value(lo) * (1 - f) + value(lo + 1) * f).alias("v"))


register("resampled", resampled, f"""
WITH {I.PATCHES}, p AS (SELECT site, i, i * (frames - 1) / 15.0 AS pos, frames FROM (SELECT DISTINCT site, frames FROM patches), (SELECT unnest(range(0, 16)) AS i))
SELECT p.site, i, round(a.v * (1 - (pos - floor(pos))) + b.v * (pos - floor(pos)), 6) AS v FROM p
JOIN patches a ON a.site = p.site AND a.t = floor(pos) JOIN patches b ON b.site = p.site AND b.t = least(floor(pos) + 1, p.frames - 1)""")


def frame_chunks(spark, sf_dir):
    """Tumbling chunks of 7 frames; a last one below half of that joins the one before."""
    f = I.patches(spark, sf_dir).select("t", "frames").distinct()
    last = F.floor((F.col("frames") - 1) / 7)
    chunk = F.floor(F.col("t") / 7)
    merged = F.when((chunk == last) & (F.col("frames") - last * 7 < 3) & (last > 0), chunk - 1).otherwise(chunk)
    return f.select("t", merged.alias("chunk"))


register("frame_chunks", frame_chunks, f"""
WITH {I.PATCHES} SELECT DISTINCT t, CASE WHEN t // 7 = (frames - 1) // 7 AND frames - (frames - 1) // 7 * 7 < 3 AND (frames - 1) // 7 > 0 THEN t // 7 - 1 ELSE t // 7 END AS chunk FROM patches""")
