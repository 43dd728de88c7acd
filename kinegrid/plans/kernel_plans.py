"""Queries that run a NumPy kernel once for each group; the relational part around it stays in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import grids as G
from ..operators import kernels as K
from ..operators import linkage as L
from ..operators import modes as M
from ..operators import registration as R
from . import inputs as I
from .join_plans import active_cells, compatible_regions
from .registration_plans import image
from .registry import register
from .window_plans import units


def traces(spark, sf_dir):
    return I.patches(spark, sf_dir).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("h"))


def region_distances(spark, sf_dir):
    """Sign-aware warping distance of the gated pairs' traces, by Arrow batches."""
    h = traces(spark, sf_dir).withColumn("h", F.transform("h", lambda v: v / F.greatest(F.array_max("h"), F.lit(1.0))))
    p = compatible_regions(spark, sf_dir).where("reason <> 'none'").select("i", "j", "iou")
    p = p.join(h.select(F.col("site").alias("i"), F.col("h").alias("hi")), "i").join(h.select(F.col("site").alias("j"), F.col("h").alias("hj")), "j")

    def run(batches):
        for pdf in batches:
            got = [K.signed_dtw(a, b) for a, b in zip(pdf.hi, pdf.hj, strict=True)]
            yield pd.DataFrame({"i": pdf.i, "j": pdf.j, "iou": pdf.iou, "distance": [round(x[0], 9) for x in got], "sign": [x[1] for x in got]})

    return p.mapInPandas(run, "i long, j long, iou double, distance double, sign int")


register("region_distances", region_distances)


def region_patterns(spark, sf_dir):
    """Complete-linkage patterns of the regions, from the warping distances of the gated pairs; other pairs never join."""
    d = C.checkpointed(region_distances(spark, sf_dir).select("i", "j", F.col("distance").alias("d")))
    nodes = active_cells(spark, sf_dir).select(F.col("region").alias("node")).distinct()
    return L.complete_linkage(nodes, d, 0.2).select(F.col("node").alias("region"), F.col("cluster").alias("pattern"))


register("region_patterns", region_patterns)


def field_modes(spark, sf_dir):
    """Sparse, compact shared modes of the block field, for each band of blocks, with what each adds."""
    b = G.block_mean(I.field(spark, sf_dir), ["t"], "x", "y", 5, ["dx", "dy"], 40, 25)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, coords = band_field(pdf)
        m = M.fit_modes(y, coords)
        mass, part = np.hypot(m.b[..., 0], m.b[..., 1]).sum(1), M.contributions(y, m)
        return pd.DataFrame({"band": pdf["by"].iloc[0], "mode": range(len(m.h)), "activation": list(m.h), "support": m.support.sum(1), "mass": mass.round(6), "contribution": part.round(6), "explained": round(m.explained, 6)})

    return b.groupBy("by").applyInPandas(fit, "band long, mode int, activation array<double>, support long, mass double, contribution double, explained double")


def band_field(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The field (t, n, 2) of one band around its mean, missing blocks at rest, and the blocks' places."""
    t, n = np.unique(pdf.t, return_inverse=True)
    x, m = np.unique(pdf.bx, return_inverse=True)
    y = np.zeros((len(t), len(x), 2))
    y[n, m, 0], y[n, m, 1] = pdf.dx - pdf.dx.mean(), pdf.dy - pdf.dy.mean()
    return y, np.stack([x.astype(float), np.full(len(x), float(pdf["by"].iloc[0]))], 1)


register("field_modes", field_modes)


def energy_ranks(spark, sf_dir):
    """Of each band the least rank that explains 85 hundredths of its energy, and the shares of the first four."""
    b = G.block_mean(I.field(spark, sf_dir), ["t"], "x", "y", 5, ["dx", "dy"], 40, 25)

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        k, share = M.energy_rank(band_field(pdf)[0])
        return pd.DataFrame({"band": [pdf["by"].iloc[0]], "rank": [k], "shares": [np.round(share[:4], 6)]})

    return b.groupBy("by").applyInPandas(rank, "band long, rank int, shares array<double>")


register("energy_ranks", energy_ranks)


def resized_field(spark, sf_dir):
    """The mean field resized to 20 x 10: a weight table for each axis joined and summed, which Spark partially aggregates."""
    c = I.cells(spark, sf_dir)

    def table(size, out, name):
        index, w = K.resize_weights(size, out)
        return spark.createDataFrame([(int(i), int(index[i, k]), float(w[i, k])) for i in range(out) for k in range(index.shape[1]) if w[i, k]], f"o{name} long, {name} long, w{name} double")

    wx, wy = F.broadcast(table(40, 20, "x")), F.broadcast(table(25, 10, "y"))  # as many rows as the output has taps
    half = c.join(wx, "x").groupBy("ox", "y").agg(F.sum(F.col("wx") * F.col("dx")).alias("v"))
    return half.join(wy, "y").groupBy("ox", "oy").agg(F.round(F.sum(F.col("wy") * F.col("v")), 6).alias("v"))


register("resized_field", resized_field, f"""
WITH {I.CELLS}, o AS (SELECT 'x' AS axis, 40 AS n, 0.5 AS s, unnest(range(0, 20)) AS o UNION ALL SELECT 'y', 25, 0.4, unnest(range(0, 10))), i AS (SELECT unnest(range(-14, 56)) AS i),
a AS (SELECT axis, n, o, i, abs(CAST(s AS DOUBLE) * ((o + 0.5) / CAST(s AS DOUBLE) - 0.5 - i)) AS a FROM o, i),
c AS (SELECT *, CASE WHEN a <= 1 THEN 1.5*a*a*a - 2.5*a*a + 1 WHEN a <= 2 THEN -0.5*a*a*a + 2.5*a*a - 4*a + 2 ELSE 0 END AS c FROM a),
w AS (SELECT axis, o, CASE WHEN (i + 2*n) % (2*n) < n THEN (i + 2*n) % (2*n) ELSE 2*n - 1 - (i + 2*n) % (2*n) END AS k, c / sum(c) OVER (PARTITION BY axis, o) AS w FROM c WHERE c <> 0)
SELECT p.o AS ox, q.o AS oy, round(sum(p.w * q.w * dx), 6) AS v FROM cells JOIN w p ON p.axis = 'x' AND p.k = x JOIN w q ON q.axis = 'y' AND q.k = y GROUP BY ALL""")


def pattern_modes(spark, sf_dir):
    """One activation for each pattern: members resampled, signs aligned with the medoid's, strength-weighted mean."""
    p = region_patterns(spark, sf_dir)
    h = traces(spark, sf_dir).withColumn("w", F.greatest(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), F.lit(1.0)))
    j = p.join(h, F.col("region") == F.col("site")).select("pattern", "region", "h", "w")

    def unify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("region")
        mean, signs, best = K.unified_trace(list(pdf.h), pdf.w.to_numpy())
        return pd.DataFrame({"pattern": [int(pdf.pattern.iloc[0])], "members": [len(pdf)], "medoid": [int(pdf.region.iloc[best])], "flipped": [int((signs < 0).sum())], "activation": [mean.round(6)]})

    return j.groupBy("pattern").applyInPandas(unify, "pattern long, members long, medoid long, flipped long, activation array<double>")


register("pattern_modes", pattern_modes)


def pattern_summaries(spark, sf_dir):
    """Each pattern of two regions at least: its regions and episodes (intervals of its sites' units), strength, effective
    area, weighted centre and covariance over the members' active cells."""
    p = region_patterns(spark, sf_dir)
    cells = active_cells(spark, sf_dir).join(I.patches(spark, sf_dir).select(F.col("site").alias("region"), F.col("t").cast("long").alias("x"), "v"), ["region", "x"])
    stats = G.weighted_stats(cells.join(p, "region").groupBy("pattern", "x", "y").agg(F.sum("v").alias("v")), ["pattern"], "v")
    ids = p.groupBy("pattern").agg(F.array_sort(F.collect_list("region")).alias("regions"))  # of one clustered component, in memory there
    e = units(spark, sf_dir).join(p, F.col("site") == F.col("region")).groupBy("pattern").agg(F.count_distinct("t0", "t1").alias("episodes"))
    out = stats.join(ids.where(F.size("regions") >= 2), "pattern").join(e, "pattern", "left")
    return out.select("pattern", "regions", F.coalesce("episodes", F.lit(0)).cast("long").alias("episodes"), F.round("strength", 4).alias("strength"), *(F.round(c, 5).alias(c) for c in ("area_eff", "cx", "cy", "vxx", "vyy", "vxy")))


register("pattern_summaries", pattern_summaries)


def simulated_recovery(spark, sf_dir):
    """A sweep of amplitudes, radii and noise: planted motion on the mean field, registered back; seeds are the rows' own."""
    grid = spark.range(0, 24).select("id", (F.col("id") % 4 * 0.4 + 0.4).alias("amplitude"), (F.floor(F.col("id") / 4) % 3 * 2 + 4).alias("radius"), (F.floor(F.col("id") / 12) * 0.05).alias("noise"))
    cells = I.cells(spark, sf_dir).agg(F.collect_list(F.struct("x", "y", "dx")).alias("cells"))  # the grid's 1000 cells at most
    rows = grid.join(F.broadcast(cells))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = R.resize(R.mean_box(image([c["x"] for c in r.cells], [c["y"] for c in r.cells], [c["dx"] for c in r.cells]), (2, 2)), (80, 50))
                u = np.stack(K.motion_field(a.shape, r.amplitude, int(r.radius), int(r.id)))
                moved = R.warp(a, -u) + np.random.default_rng(int(r.id) + 1000).normal(scale=r.noise, size=a.shape)
                m = R.flow(moved, a, layers=2, radius=4)
                off = np.hypot(*(m.field - u))[6:-6, 6:-6]
                out.append((r.id, r.amplitude, r.radius, r.noise, round(float(off.mean()), 6), round(m.before, 6), round(m.after, 6)))
            yield pd.DataFrame(out, columns=["id", "amplitude", "radius", "noise", "endpoint_error", "error_before", "error_after"])

    return rows.repartition(8, "id").mapInPandas(run, "id long, amplitude double, radius long, noise double, endpoint_error double, error_before double, error_after double")


register("simulated_recovery", simulated_recovery)
