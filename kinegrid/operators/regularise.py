"""Confidence-weighted smoothing of a grid as a coupled linear system, solved on a table.

The field z minimises the sum of conf (z - mu)^2 over the cells and of lam (difference)^2 over neighbours. Every round,

    z = (conf mu + lam (up + down + left + right)) / (conf + 4 lam + eps),

is one aggregate: a cell sends its value to its four neighbours and its own row to itself, so nothing is joined and a
grid of any size is dealt over tasks. A neighbour outside the grid, or a cell that is missing, counts as the cell itself.
Rounds are written to the checkpoint folder every few, and with a tolerance the residual is tested there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

WAYS = {"own": (0, 0), "up": (1, 0), "down": (-1, 0), "left": (0, 1), "right": (0, -1)}


def one_round(cells: DataFrame, lam: float, eps: float) -> DataFrame:
    """(x, y, mu, conf, z) -> the same with the next z; ``moved`` is how far it went."""
    ways = F.array(*(F.struct(F.lit(w).alias("way"), F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for w, (i, j) in WAYS.items()))
    sent = cells.select("x", "y", "mu", "conf", "z", F.explode(ways).alias("o"))
    own = F.col("o.way") == "own"
    only = lambda c: F.when(own, F.col(c)).alias(c)
    sent = sent.select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("o.way").alias("way"), only("mu"), only("conf"), "z")
    value = lambda w: F.max(F.when(F.col("way") == w, F.col("z"))).alias(w)
    met = sent.groupBy("x", "y").agg(F.max("mu").alias("mu"), F.max("conf").alias("conf"), *(value(w) for w in WAYS)).where("own is not null")
    up, down, left, right = (F.coalesce(w, "own") for w in ("up", "down", "left", "right"))
    z = (F.col("conf") * F.col("mu") + lam * (up + down + left + right)) / (F.col("conf") + 4 * lam + eps)
    return met.select("x", "y", "mu", "conf", z.alias("z"), F.abs(z - F.col("own")).alias("moved"))


def smoothed(cells: DataFrame, lam: float = 1.0, rounds: int = 40, eps: float = 1e-6, tolerance: float | None = None, every: int = 8) -> DataFrame:
    """(x, y, z) after so many rounds over (x, y, mu, conf), fewer if no cell moves by more than the tolerance.

    A null mu has no confidence and takes its neighbours' values; null confidence is 0."""
    conf = F.when(F.col("mu").isNull(), 0.0).otherwise(F.coalesce("conf", F.lit(0.0)))
    start = cells.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.coalesce("mu", F.lit(0.0)).cast("double").alias("mu"), conf.cast("double").alias("conf"))
    z = start.withColumn("z", F.col("mu"))
    for k in range(1, rounds + 1):
        z = one_round(z, lam, eps)
        if k % every == 0 or k == rounds:
            z = checkpointed(z)
            if tolerance is not None and (z.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
                break
        z = z.drop("moved")
    return z.select("x", "y", "z")
