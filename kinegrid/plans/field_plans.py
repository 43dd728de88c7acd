"""Queries of growth, smoothing, energy and sketches over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gram as M
from ..operators import grids as G
from ..operators import growth as W
from ..operators import maxtree as T
from ..operators import regularise as Z
from ..operators import sketches as K
from ..operators import tiles as H
from . import inputs as I
from .registry import register


def constrained_growth(spark, sf_dir):
    """Seeds, the strongest cells of the volume's years, grown over its moderately strong cells for six steps; a step in z is two."""
    v = I.volume(spark, sf_dir).groupBy("x", "y", "z").agg(F.max("v").alias("v"))
    seeds = v.where("v >= 49").select((F.col("x") * 1000 + F.col("y") * 10 + F.col("z")).alias("label"), "x", "y", "z")
    return W.grow(seeds, v.where("v >= 35"), W.ball(2, 2.0), 6).select("x", "y", "z", "label", F.col("step").cast("long").alias("step"))


register("constrained_growth", constrained_growth, f"""
WITH RECURSIVE {I.VOLUME}, v AS (SELECT x, y, z, max(v) AS v FROM volume GROUP BY ALL), allowed AS (SELECT x, y, z FROM v WHERE v >= 35),
i AS (SELECT unnest(range(-2, 3)) AS d), o AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM i a, i b, i c WHERE a.d * a.d + b.d * b.d + 4 * c.d * c.d BETWEEN 1 AND 4),
g AS (
  SELECT x, y, z, x * 1000 + y * 10 + z AS label, 0 AS step FROM v WHERE v >= 49
  UNION SELECT allowed.x, allowed.y, allowed.z, label, step + 1 FROM g JOIN o ON step < 6 JOIN allowed ON allowed.x = g.x + dx AND allowed.y = g.y + dy AND allowed.z = g.z + dz)
SELECT x, y, z, min(label) AS label, CAST(step AS BIGINT) AS step FROM (SELECT *, min(step) OVER (PARTITION BY x, y, z) AS least FROM g) WHERE step = least GROUP BY x, y, z, step""")


def smoothed_grid(spark, sf_dir):
    """The field's mean displacement, smoothed with the part of its rows that a cell has as confidence."""
    c = I.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 25).alias("y")).agg(F.avg("l_quantity").alias("mu"), (F.count("*") / 100).alias("conf"))
    return Z.smoothed(c, lam=0.5, rounds=40).select("x", "y", S.r6(F.col("z")).alias("z"))


def _rounds(n: int) -> str:
    """The same rounds, one table after the other."""
    near = lambda by, over, k: f"coalesce(max(z) OVER (PARTITION BY {by} ORDER BY {over} RANGE BETWEEN {k} AND {k}), z)"
    up, down, left, right = near("y", "x", "1 PRECEDING"), near("y", "x", "1 FOLLOWING"), near("x", "y", "1 PRECEDING"), near("x", "y", "1 FOLLOWING")
    return ", ".join(f"z{k} AS MATERIALIZED (SELECT x, y, mu, conf, (conf * mu + 0.5 * ({up} + {down} + {left} + {right})) / (conf + 4 * 0.5 + 1e-6) AS z FROM z{k - 1})" for k in range(1, n + 1))


register("smoothed_grid", smoothed_grid, f"""
WITH z0 AS (SELECT l_partkey % 40 AS x, l_suppkey % 25 AS y, avg(l_quantity) AS mu, count(*) / 100 AS conf, avg(l_quantity) AS z FROM lineitem GROUP BY ALL), {_rounds(40)}
SELECT x, y, round(z, 6) AS z FROM z40""")


def gram_matrix(spark, sf_dir):
    """Products of the embeddings' entries over all rows."""
    e = I.table(spark, sf_dir, "embeddings")
    return M.gram(e, "embedding", 64).select("i", "j", F.round("g", 5).alias("g"))


register("gram_matrix", gram_matrix, """
WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), i AS (SELECT unnest(range(0, 64)) AS i)
SELECT a.i, b.i AS j, round(sum(e[a.i + 1] * e[b.i + 1]), 5) AS g FROM e, i a, i b WHERE a.i <= b.i GROUP BY ALL""")


def gram_energy(spark, sf_dir):
    """Energy of each component of all embeddings, and whether it is among those that hold 90% of it."""
    energy = M.energies(M.gram(I.table(spark, sf_dir, "embeddings"), "embedding", 64), 64)
    kept, total = M.rank_for(energy, 0.9), float(energy.sum()) or 1.0
    rows = [(i + 1, float(np.round(v, 4)), float(np.round(c, 6)), i < kept) for i, (v, c) in enumerate(zip(energy, np.cumsum(energy) / total, strict=True))]
    return spark.createDataFrame(rows, "component long, energy double, held double, kept boolean")


register("gram_energy", gram_energy)

RANGES, QUANTILES = [(0, 10), (7, 25), (0, 30)], [0.01, 0.5, 0.99]


def limit_sketches(spark, sf_dir):
    """Contrast limits of three ranges of days from a sketch a day; ``within``: the limit's rank is off by no more than the bound."""
    p = I.patches(spark, sf_dir).select(F.col("t").cast("long").alias("t"), "v")
    ranges = spark.createDataFrame(RANGES, "first long, after long")
    found = K.range_limits(K.frame_sketches(p, "t", "v"), ranges, "t", QUANTILES)
    q = F.explode(F.arrays_zip(F.array(*(F.lit(x) for x in QUANTILES)).alias("q"), F.col("limits").alias("v"))).alias("o")
    limits = found.select("first", "after", "n", q).select("first", "after", "n", F.col("o.q").alias("q"), F.col("o.v").alias("limit"))
    days = limits.select("first", "after", "n", "q", "limit", F.explode(F.sequence(F.col("first"), F.col("after") - 1)).alias("t"))
    ranks = days.join(p, "t").groupBy("first", "after", "n", "q").agg(F.avg((F.col("v") < F.col("limit")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("limit")).cast("double")).alias("upto"))
    return ranks.select("first", "after", "n", "q", ((F.col("below") - K.rank_error() <= F.col("q")) & (F.col("q") <= F.col("upto") + K.rank_error())).alias("within"))


register("limit_sketches", limit_sketches, f"""
WITH {I.PATCHES}, r AS (SELECT * FROM (VALUES (0, 10), (7, 25), (0, 30)) r(first, after)), q AS (SELECT unnest([0.01, 0.5, 0.99]) AS q)
SELECT CAST(first AS BIGINT) AS first, CAST(after AS BIGINT) AS after, count(*) AS n, CAST(q AS DOUBLE) AS q, true AS within FROM r JOIN patches ON t >= first AND t < after, q GROUP BY ALL""")


LEVELS = [26.0, 27.0, 28.0, 29.0, 30.0]


def level_tree(spark, sf_dir):
    """Components of the mean field at five thresholds with area, peak and parent, from one spanning forest."""
    cells = I.cells(spark, sf_dir).select(G.cell_key("x", "y").alias("node"), "x", "y", F.col("dx").alias("v"))
    forest = T.spanning_forest(T.cell_edges(cells, G.neighbours(cells, "node", [])))
    return T.level_tree(cells, forest, LEVELS).select("threshold", "component", "area", S.r6(F.col("peak")).alias("peak"), "parent")


register("level_tree", level_tree, f"""
WITH RECURSIVE {I.CELLS}, l AS (SELECT unnest({LEVELS}) AS threshold),
n AS (SELECT CAST(threshold AS DOUBLE) AS threshold, x, y, x * 4294967296 + y AS node, dx AS v FROM cells, l WHERE dx >= threshold),
e AS (SELECT a.threshold, a.node AS a, b.node AS b FROM n a JOIN n b ON a.threshold = b.threshold AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.node <> b.node),
r AS (SELECT threshold, node AS a, node AS b FROM n UNION SELECT r.threshold, r.a, e.b FROM r JOIN e ON r.threshold = e.threshold AND r.b = e.a),
c AS (SELECT threshold, a AS node, min(b) AS component FROM r GROUP BY threshold, a),
s AS (SELECT threshold, component, count(*) AS area, max(v) AS peak FROM n JOIN c USING (threshold, node) GROUP BY ALL)
SELECT s.threshold, s.component, area, round(peak, 6) AS peak, c.component AS parent FROM s LEFT JOIN c ON c.threshold = s.threshold - 1 AND c.node = s.component""")


KERNEL = [[0.0, -1.0, 0.5], [-2.0, 4.0, 1.0], [0.0, 3.0, -0.25]]


def tiled_filter(spark, sf_dir):
    """The field of every month correlated with a kernel of no symmetry, by tiles of 16 cells; borders are repeated."""
    out = H.correlate(I.field(spark, sf_dir), ["t"], "dx", np.array(KERNEL), 40, 25, "replicate", 16)
    return out.select("t", "x", "y", F.round("dx", 5).alias("v"))


register("tiled_filter", tiled_filter, f"""
WITH {I.FIELD}, k AS (SELECT * FROM (VALUES {', '.join(f'({i - 1}, {j - 1}, CAST({w} AS DOUBLE))' for i, row in enumerate(KERNEL) for j, w in enumerate(row))}) k(i, j, w)),
n AS (SELECT t, x, y, greatest(0, least(39, x + i)) AS nx, greatest(0, least(24, y + j)) AS ny, w FROM field, k)
SELECT n.t, n.x, n.y, round(sum(w * coalesce(f.dx, 0.0)), 5) AS v FROM n LEFT JOIN field f ON f.t = n.t AND f.x = n.nx AND f.y = n.ny GROUP BY ALL""")
