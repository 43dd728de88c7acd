"""Quantiles of any range of frames from a sketch a frame: written once, merged for each request.

The sketches are KLL sketches with parameter k; a quantile from them has a rank that is off by no more than ``rank_error(k)``
of the range's rows (with 99% confidence), however many sketches were merged. A frame of any size becomes a row of some
kilobytes, from partial sketches that Spark merges, so a request reads frames and not cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400


def rank_error(k: int = K) -> float:
    """Bound of the error of a rank, as a part of all rows (the published fit of the sketch's error)."""
    return 2.296 / k**0.9021


def frame_sketches(rows: DataFrame, frame: str, value: str, k: int = K) -> DataFrame:
    """(frame, n, low, high, sketch) of each frame with values that are neither null nor NaN."""
    v = F.col(value).cast("double")
    kept = rows.select(F.col(frame), v.alias("_kg_v")).where(v.isNotNull() & ~F.isnan(v))
    return kept.groupBy(frame).agg(F.count("*").alias("n"), F.min("_kg_v").alias("low"), F.max("_kg_v").alias("high"), F.kll_sketch_agg_double("_kg_v", F.lit(k)).alias("sketch"))


def range_limits(sketches: DataFrame, ranges: DataFrame, frame: str, at: list[float], k: int = K) -> DataFrame:
    """(first, after, n, low, high, limits): quantiles ``at`` of the frames from first to before after, a row for each range that has any.

    ranges: (first, after). A range meets its frames by their numbers, so none is compared with all frames."""
    wanted = ranges.select("first", "after", F.explode(F.sequence(F.col("first"), F.col("after") - 1)).alias(frame)).where("after > first")
    met = wanted.join(sketches, frame).groupBy("first", "after")
    merged = met.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    limits = F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in at))
    return merged.select("first", "after", "n", "low", "high", limits.alias("limits"))
