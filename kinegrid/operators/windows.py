"""Ordered-sequence operators: runs, gap closing, rolling robust thresholds, event detection, interval union.

A run is an island of consecutive active frames; gaps are closed by the island's boundary predicate, so a
series is sorted once for all steps of a detection. Helper columns are named _kg_...; callers' columns keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD = 1.4826


def islands(rows: DataFrame, keys: list[str], t: str, gap: int = 0) -> DataFrame:
    """(keys, t0, t1, n): runs of the frames in rows; frames more than gap + 1 apart begin a new run."""
    order = Window.partitionBy(*keys).orderBy(t)
    new = F.when(F.col(t) - F.lag(t).over(order) <= gap + 1, 0).otherwise(1)
    numbered = rows.withColumn("_kg_new", new).withColumn("_kg_run", F.sum("_kg_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_kg_run").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n")).drop("_kg_run")


def union_intervals(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """(keys, t0, t1, n): merged intervals; one joins the ones before if it starts at most gap + 1 after their last end."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    last = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("_kg_new", F.when(F.col(start) <= last + gap + 1, 0).otherwise(1)).withColumn("_kg_run", F.sum("_kg_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_kg_run").agg(F.min(start).alias("t0"), F.max(end).alias("t1"), F.count("*").alias("n")).drop("_kg_run")


def rolling_rest(rows: DataFrame, keys: list[str], t: str, v: str, half: int, scale: float) -> DataFrame:
    """Adds ``rest``: rolling median plus scale times the rolling MAD (as a standard deviation)."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)
    rows = rows.withColumn("_kg_med", F.percentile(v, F.lit(0.5)).over(w))
    rows = rows.withColumn("_kg_mad", F.percentile(F.abs(F.col(v) - F.col("_kg_med")), F.lit(0.5)).over(w))
    return rows.withColumn("rest", F.col("_kg_med") + F.lit(scale * MAD) * F.col("_kg_mad")).drop("_kg_med", "_kg_mad")


def motion_units(rows: DataFrame, keys: list[str], t: str, v: str, frames: Column, half: int = 5, scale: float = 2.0, close: int = 1, extend: int = 1) -> DataFrame:
    """(keys, t0, t1): active runs above the rolling threshold, gaps closed, extended and merged where they touch."""
    active = rolling_rest(rows, keys, t, v, half, scale).where(F.col(v) > F.col("rest"))
    runs = islands(active.withColumn("_kg_frames", frames), [*keys, "_kg_frames"], t, close)
    wide = runs.select(*keys, F.greatest(F.lit(0), F.col("t0") - extend).alias("s"), F.least(F.col("_kg_frames") - 1, F.col("t1") + extend).alias("e"))
    return union_intervals(wide, keys, "s", "e", 0)


def mad_events(rows: DataFrame, keys: list[str], t: str, v: str, k: float, gap: int, least: int) -> DataFrame:
    """(keys, t0, t1, n, peak_t, peak): runs above median + k MAD; where the MAD is 0 the standard deviation serves."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_kg_med", F.percentile(v, F.lit(0.5)).over(w))
    rows = rows.withColumn("_kg_mad", F.percentile(F.abs(F.col(v) - F.col("_kg_med")), F.lit(0.5)).over(w) * MAD).withColumn("_kg_sd", F.stddev_pop(v).over(w))
    spread = F.when(F.col("_kg_mad") > 0, F.col("_kg_mad")).otherwise(F.col("_kg_sd"))
    active = rows.where(F.col(v) > F.col("_kg_med") + k * spread)
    order = Window.partitionBy(*keys).orderBy(t)
    new = F.when(F.col(t) - F.lag(t).over(order) <= gap + 1, 0).otherwise(1)
    runs = active.withColumn("_kg_new", new).withColumn("_kg_run", F.sum("_kg_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_kg_run").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"), F.max_by(t, F.struct(v, -F.col(t))).alias("peak_t"), F.max(v).alias("peak"))
    return out.where(F.col("t1") - F.col("t0") + 1 >= least).drop("_kg_run")


def dff(rows: DataFrame, keys: list[str], v: str, baseline: float = 0.2, eps: float = 1e-6) -> DataFrame:
    """Adds ``dff``: change against the baseline quantile of the series."""
    b = F.percentile(v, F.lit(baseline)).over(Window.partitionBy(*keys))
    return rows.withColumn("_kg_base", b).withColumn("dff", (F.col(v) - F.col("_kg_base")) / (F.abs("_kg_base") + eps)).drop("_kg_base")


def smooth(rows: DataFrame, keys: list[str], t: str, v: str, half: int, out: str) -> DataFrame:
    """Centred moving average with zero padding: the divisor is always the full width."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)
    return rows.withColumn(out, F.sum(v).over(w) / (2 * half + 1))


def window_probability(rows: DataFrame, keys: list[str], t: str, active: str, length: int) -> DataFrame:
    """(keys, prob): part of the windows of so many frames that hold an active one."""
    order = Window.partitionBy(*keys).orderBy(t)
    ahead = order.rowsBetween(0, length - 1)
    full = rows.withColumn("_kg_any", F.max(F.col(active).cast("int")).over(ahead)).withColumn("_kg_n", F.count("*").over(ahead)).where(F.col("_kg_n") == length)
    return full.groupBy(*keys).agg(F.avg("_kg_any").alias("prob"))


def hit_rate(rows: DataFrame, events: DataFrame, keys: list[str], t: str, active: str, length: Column | int, frames: int, by: list[str] | None = None, each: list[str] | None = None) -> DataFrame:
    """(keys, each, windows, hits): of the events' windows, clipped to the series, those that hold an active frame.

    The count of active frames in a window is a difference of running counts at its two ends: two
    equi-joins, whatever the window's length. events: (by, each, start); a series meets the events of its own ``by`` (all events without any).
    """
    by, each = by or [], each or []
    order = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select(*by, *keys, F.col(t).cast("long").alias(t), F.sum(F.col(active).cast("int")).over(order).alias("c"))
    spans = events.select(*by, *each, F.greatest(F.lit(0), F.col("start")).cast("long").alias("s"), F.least(F.lit(frames), F.col("start") + length).cast("long").alias("e")).where("s < e")
    spans = spans.groupBy(*by, *each, "s", "e").agg(F.count("*").alias("_kg_times")).withColumn(t, F.col("e") - 1)
    ends = running.join(spans, [*by, t]).select(*keys, *each, "s", "_kg_times", F.col("c").alias("_kg_hi"))
    before = running.select(*keys, (F.col(t) + 1).alias("s"), F.col("c").alias("_kg_lo"))
    both = ends.join(before, [*keys, "s"], "left").withColumn("_kg_hit", (F.col("_kg_hi") - F.coalesce("_kg_lo", F.lit(0)) > 0).cast("int"))
    return both.groupBy(*keys, *each).agg(F.sum("_kg_times").alias("windows"), F.sum(F.col("_kg_hit") * F.col("_kg_times")).alias("hits"))
