"""Constrained growth: seeds spread over allowed cells step by step, every cell to the label that reaches it first.

A step is a join of the frontier's neighbours with the allowed cells and an anti join with what has been reached; steps
are bounded by the reach, and each is written to the checkpoint folder, so a plan holds one step. Costs follow the
frontier, not the volume.
"""

from __future__ import annotations

from itertools import product
from math import ceil, isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

AXES = ["x", "y", "z"]


def ball(radius: float, z_ratio: float = 1.0) -> list[tuple[int, int, int]]:
    """Offsets within a physical radius, where one step in z is z_ratio steps in x and y; the centre is left out."""
    if not (isfinite(z_ratio) and z_ratio > 0 and radius > 0):
        raise ValueError("radius and z_ratio must be positive and finite")
    flat, deep = int(radius), ceil(radius / z_ratio)
    every = product(range(-flat, flat + 1), range(-flat, flat + 1), range(-deep, deep + 1))
    return [o for o in every if 0 < o[0] ** 2 + o[1] ** 2 + (o[2] * z_ratio) ** 2 <= radius**2 + 1e-6]


def grow(seeds: DataFrame, allowed: DataFrame, offsets: list[tuple[int, int, int]], steps: int) -> DataFrame:
    """(x, y, z, label, step) of the seeds (label, x, y, z) on allowed cells (step 0) and what they reach in so many steps.

    Cells that several labels reach in the same step, or that have several seeds, take the least label."""
    inside = checkpointed(allowed.select(*(F.col(a).cast("long").alias(a) for a in AXES)).distinct())
    near = F.explode(F.array(*(F.struct(*(F.lit(v).cast("long").alias(f"d{a}") for a, v in zip(AXES, o, strict=True))) for o in offsets))).alias("o")
    found = seeds.select(F.col("label"), *(F.col(a).cast("long").alias(a) for a in AXES)).groupBy(*AXES).agg(F.min("label").alias("label"))
    frontier = checkpointed(found.join(inside, AXES, "left_semi").withColumn("step", F.lit(0)).select(*AXES, "label", "step"))
    parts = [frontier]
    # with offsets that lead back, a neighbour of the last step's cells that was reached before was so at most two steps ago
    both_ways = {tuple(-d for d in o) for o in offsets} == set(offsets)
    for k in range(1, steps + 1):
        if frontier.isEmpty():
            break
        moved = frontier.select("label", near, *AXES).select("label", *((F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES))
        fresh = moved.groupBy(*AXES).agg(F.min("label").alias("label")).join(inside, AXES, "left_semi")
        for p in parts[-2:] if both_ways else parts:
            fresh = fresh.join(p, AXES, "left_anti")
        frontier = checkpointed(fresh.withColumn("step", F.lit(k)).select(*AXES, "label", "step"))
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
