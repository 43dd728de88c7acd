"""Exact order statistics of one column, or of every group, without sorting, by counting in narrowing brackets.

Each pass counts the values of every open bracket in buckets of equal width (an aggregate whose groups are bounded by
brackets times BUCKETS) and keeps the bucket that holds a wanted rank. When the open brackets hold few different values
those are counted themselves. So nothing but counts is shuffled, and the driver sees bounded tables only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
FEW = 50_000  # rows in open brackets that are counted value by value


def order_statistics(rows: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values of the given ranks (0 is the least) among the column's values that are neither null nor NaN."""
    v = F.col(value).cast("double")
    rows = rows.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    total, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if any(not 0 <= r < total for r in ranks):
        raise ValueError(f"a rank is not among the {total} values")
    found: dict[int, float] = {}
    # open brackets: values from lo to hi, both included, with what lies before them and the ranks sought there
    brackets = [(low, high, 0, total, sorted(set(ranks)))]
    while brackets:
        for lo, hi, *_, sought in brackets:
            if lo == hi:
                found |= dict.fromkeys(sought, lo)
        brackets = [b for b in brackets if b[0] < b[1]]
        if not brackets:
            break
        which = F.lit(None).cast("int")
        bucket = F.lit(None).cast("long")
        small = sum(b[3] for b in brackets) <= FEW
        for i, (lo, hi, *_) in enumerate(brackets):
            inside = (F.col("v") >= lo) & (F.col("v") <= hi)
            which = F.when(inside, i).otherwise(which)
            step = (hi / 2 - lo / 2) / BUCKETS * 2  # no overflow
            at = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - lo) / step)) if step > 0 else F.when(F.col("v") == lo, 0).otherwise(1)
            bucket = F.when(inside, at.cast("long")).otherwise(bucket)
        part = rows.select("v", which.alias("i"), bucket.alias("b")).where("i is not null")
        groups = part.groupBy("i", F.col("v").alias("b")) if small else part.groupBy("i", "b")
        counts: dict[int, list] = {}
        for r in groups.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counts.setdefault(r["i"], []).append((r["lo"], r["hi"], r["n"]))
        narrower = []
        for i, (_, _, before, _, sought) in enumerate(brackets):
            for lo, hi, n in sorted(counts[i]):
                here = [r for r in sought if before <= r < before + n]
                if here:
                    narrower.append((lo, hi, before, n, here))
                before += n
        brackets = narrower
    return [found[r] for r in ranks]


def quantiles(rows: DataFrame, value: str, at: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles; of a column without values None."""
    v = F.col(value).cast("double")
    total = rows.where(v.isNotNull() & ~F.isnan(v)).count()
    if not total:
        return [None] * len(at)
    places = [q * (total - 1) for q in at]
    ranks = sorted({r for p in places for r in (int(p), min(int(p) + 1, total - 1))})
    found = dict(zip(ranks, order_statistics(rows, value, ranks), strict=True))
    return [found[int(p)] + (p - int(p)) * (found[min(int(p) + 1, total - 1)] - found[int(p)]) for p in places]


def group_quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float], buckets: int = 1024) -> DataFrame:
    """(keys, one column for each name in ``at``, n): linearly interpolated quantiles of every group, exact, in one plan.

    A group's range is cut into ``buckets`` of equal width and these are counted, which Spark combines before it
    shuffles; only the few buckets that hold a wanted rank are then counted value by value. So a group with any number of
    rows costs its tasks counts alone. Nulls and NaN are left out, a group without other values gives no row; null keys are a group.
    """
    v = F.col(value).cast("double")
    rows = rows.select(*keys, v.alias("_kg_v")).where(v.isNotNull() & ~F.isnan(v))
    ends = rows.groupBy(*keys).agg(F.min("_kg_v").alias("_kg_lo"), F.max("_kg_v").alias("_kg_hi"), F.count("*").alias("n"))
    places = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in at.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.least(F.floor(p) + 1, F.col("n") - 1)) for p in places.values()))))

    joined = rows.alias("r").join(ends.alias("e"), [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]).select(*(F.col(f"r.{k}").alias(k) for k in keys), "_kg_v", "_kg_lo", "_kg_hi", "n")
    part = F.coalesce(F.try_divide(F.col("_kg_v") / 2 - F.col("_kg_lo") / 2, F.col("_kg_hi") / 2 - F.col("_kg_lo") / 2), F.lit(0.0))
    joined = joined.withColumn("_kg_b", F.least(F.lit(buckets - 1), F.floor(part * buckets).cast("int")))

    def sought(counts: DataFrame, within: list[str], order: str, before: Column) -> DataFrame:
        """Rows of counts with the ranks that fall on them, one row for each."""
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        first = before + F.sum("_kg_c").over(w) - F.col("_kg_c")
        held = counts.withColumn("_kg_first", first)
        mine = F.filter("_kg_ranks", lambda r: (r >= F.col("_kg_first")) & (r < F.col("_kg_first") + F.col("_kg_c")))
        return held.withColumn("_kg_ranks", mine).where(F.size("_kg_ranks") > 0)

    coarse = joined.groupBy(*keys, "_kg_b").agg(F.count("*").alias("_kg_c"), F.min("_kg_v").alias("_kg_from"), F.max("_kg_v").alias("_kg_to"), F.first("n").alias("n"))
    coarse = sought(coarse.withColumn("_kg_ranks", ranks), keys, "_kg_b", F.lit(0))
    flat = coarse.where("_kg_from = _kg_to").select(*keys, "n", F.explode("_kg_ranks").alias("_kg_rank"), F.col("_kg_from").alias("_kg_v"))
    wide = coarse.where("_kg_from < _kg_to").select(*(F.col(k).alias(f"_kg_k{i}") for i, k in enumerate(keys)), F.col("_kg_b").alias("_kg_wb"), F.col("_kg_first").alias("_kg_before"), "_kg_ranks")
    within = [joined[k].eqNullSafe(wide[f"_kg_k{i}"]) for i, k in enumerate(keys)] + [joined["_kg_b"] == wide["_kg_wb"]]
    fine = joined.join(wide, within).groupBy(*keys, "_kg_b", "_kg_v").agg(F.count("*").alias("_kg_c"), F.first("n").alias("n"), F.first("_kg_before").alias("_kg_before"), F.first("_kg_ranks").alias("_kg_ranks"))
    fine = sought(fine, [*keys, "_kg_b"], "_kg_v", F.col("_kg_before")).select(*keys, "n", F.explode("_kg_ranks").alias("_kg_rank"), "_kg_v")

    value_at = lambda r: F.max(F.when(F.col("_kg_rank") == r, F.col("_kg_v")))
    out = flat.unionByName(fine).groupBy(*keys, "n")
    low = {name: value_at(F.floor(p)) for name, p in places.items()}
    high = {name: value_at(F.least(F.floor(p) + 1, F.col("n") - 1)) for name, p in places.items()}
    found = [(low[name] + (places[name] - F.floor(places[name])) * (high[name] - low[name])).alias(name) for name in at]
    return out.agg(*found).select(*keys, *at, "n")
