"""Queries of display layers, listings, samples and masks, and of staged and flattened tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import components as C
from ..operators import episodes as E
from ..operators import grids as G
from ..operators import kernels as K
from ..operators import modes as M
from ..operators import serving
from ..sources.arrays import sampled_frames as sampled
from . import inputs as I
from .join_plans import EPISODES, LEAST, REACH, placed, roi_classes
from .kernel_plans import band_field, resized_field
from .mask_plans import mode_regions
from .registry import oracle_sql, register


def sampled_frames(spark, sf_dir):
    """Cells of the first, the last and every twelfth month of the field."""
    f = I.field(spark, sf_dir)
    first = f.agg(F.min("t").alias("first"))
    f = f.join(F.broadcast(first)).withColumn("t", F.col("t") - F.col("first")).drop("first")
    return sampled(f, "t", 12).select("t", "x", "y", S.r6(F.col("dx")).alias("dx"))


register("sampled_frames", sampled_frames, f"""
WITH {I.FIELD}, f AS (SELECT t - (SELECT min(t) FROM field) AS t, x, y, dx FROM field)
SELECT t, x, y, round(dx, 6) AS dx FROM f WHERE t = 0 OR t = (SELECT max(t) FROM f) OR t % 12 = 0""")


def staged_blocks(spark, sf_dir):
    """Blocks of 2 x 2 of blocks of 2 x 2, each stage a mean of what it is given."""
    b = G.block_mean(I.field(spark, sf_dir), ["t"], "x", "y", 2, ["dx"], 40, 25)
    return G.block_mean(b.withColumnsRenamed({"bx": "x", "by": "y"}), ["t"], "x", "y", 2, ["dx"], 20, 12).select("t", "bx", "by", S.r6(F.col("dx")).alias("dx"))


register("staged_blocks", staged_blocks, f"""
WITH {I.FIELD}, b AS (SELECT t, x // 2 AS x, y // 2 AS y, avg(dx) AS dx FROM field WHERE x < 40 AND y < 24 GROUP BY ALL)
SELECT t, x // 2 AS bx, y // 2 AS by, round(avg(dx), 6) AS dx FROM b GROUP BY ALL""")


def mode_centroids(spark, sf_dir):
    """Each band's centre of strong responses by month; a month without any keeps the centre of the month before."""
    f = I.field(spark, sf_dir).withColumn("band", F.floor(F.col("y") / 5)).withColumn("w", F.greatest(F.lit(0.0), F.col("dx") - 40))
    s = f.groupBy("band", "t").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("x")).alias("sx"))
    c = s.withColumn("c", F.when(F.col("s") > 1e-12, F.col("sx") / F.col("s")))
    before = F.last("c", True).over(I.over("band").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("band", "t", F.round(before, 5).alias("cx"), F.col("c").isNull().alias("kept"))


register("mode_centroids", mode_centroids, f"""
WITH {I.FIELD}, c AS (SELECT y // 5 AS band, t, CASE WHEN sum(greatest(0.0, dx - 40)) > 1e-12 THEN sum(greatest(0.0, dx - 40) * x) / sum(greatest(0.0, dx - 40)) END AS c FROM field GROUP BY ALL)
SELECT band, t, round(last_value(c IGNORE NULLS) OVER (PARTITION BY band ORDER BY t ROWS UNBOUNDED PRECEDING), 5) AS cx, c IS NULL AS kept FROM c""")


def episode_units(spark, sf_dir):
    """Units of all episodes, unnested: one row for each unit, with its group's number and its episode's bounds."""
    u = placed(spark, sf_dir).withColumn("node", E.span_key("t0", "t1"))
    of = C.checkpointed(E.members(u, reach=REACH, least=LEAST))
    e = E.summary(u, of, LEAST).select("episode", F.col("t0").alias("e0"), F.col("t1").alias("e1"), "area")
    return u.join(of, "node").join(e, "episode").select("episode", "node", "site", "t0", "t1", "e0", "e1", "area")


register("episode_units", episode_units, f"""
WITH RECURSIVE {EPISODES} SELECT episode, node, site, p.t0, p.t1, e.t0 AS e0, e.t1 AS e1, area FROM placed p JOIN members USING (node) JOIN episodes e USING (episode)""")


def largest_regions(spark, sf_dir):
    """Of each month's regions the largest; of equal ones the strongest."""
    return G.best(mode_regions(spark, sf_dir), ["t"], F.desc("area"), F.desc("strength"), "cx", "cy").select("t", "area", "strength", "cx", "cy")


register("largest_regions", largest_regions, f"""
SELECT t, area, strength, cx, cy FROM ({oracle_sql()['mode_regions']}) QUALIFY row_number() OVER (PARTITION BY t ORDER BY area DESC, strength DESC, cx, cy) = 1""")


def resampled_mask(spark, sf_dir):
    """Cells of the resized field above a threshold."""
    return resized_field(spark, sf_dir).where("v > 25.5").select("ox", "oy")


register("resampled_mask", resampled_mask, f"SELECT ox, oy FROM ({oracle_sql()['resized_field']}) WHERE v > 25.5")


def nearest_supersampled(spark, sf_dir):
    """The mean field on a grid twice as fine by the nearest cell (halves to even), endpoints included."""
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(79))).alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("j"))
    g = grid.select("i", "j", F.rint(F.col("i") * 39.0 / 79.0).cast("long").alias("x"), F.rint(F.col("j") * 24.0 / 49.0).cast("long").alias("y"))
    return g.join(I.cells(spark, sf_dir), ["x", "y"]).select("i", "j", S.r6(F.col("dx")).alias("v"))


register("nearest_supersampled", nearest_supersampled, f"""
WITH {I.CELLS}, g AS (SELECT i, j, CAST(round_even(i * 39.0 / 79.0, 0) AS BIGINT) AS x, CAST(round_even(j * 24.0 / 49.0, 0) AS BIGINT) AS y FROM (SELECT unnest(range(0, 80)) AS i), (SELECT unnest(range(0, 50)) AS j))
SELECT i, j, round(dx, 6) AS v FROM g JOIN cells USING (x, y)""")


def arrow_overlay(spark, sf_dir):
    """Arrows of the mean field at every fifth cell: start, end and hue by direction."""
    return serving.arrows(I.cells(spark, sf_dir), 5, 0.1).select("x", "y", *(S.r6(F.col(c)).alias(c) for c in ("x1", "y1", "hue")))


register("arrow_overlay", arrow_overlay, f"""
WITH {I.CELLS} SELECT x, y, round(x + 0.1 * dx, 6) AS x1, round(y + 0.1 * dy, 6) AS y1, round((degrees(atan2(dy, dx)) + 360.0) % 360.0, 6) AS hue FROM cells WHERE x % 5 = 0 AND y % 5 = 0""")


def montage_cells(spark, sf_dir):
    """The months' images side by side, twelve a row, in the order of the months."""
    f = I.field(spark, sf_dir)
    return serving.montage(f, "t", 12, 40, 25).select("t", "row", "column", F.col("mx").cast("long").alias("mx"), F.col("my").cast("long").alias("my"), S.r6(F.col("dx")).alias("dx"))


register("montage_cells", montage_cells, f"""
WITH {I.FIELD}, k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM (SELECT DISTINCT t FROM field))
SELECT t, k // 12 AS row, k % 12 AS column, (k % 12) * 40 + x AS mx, (k // 12) * 25 + y AS my, round(dx, 6) AS dx FROM field JOIN k USING (t)""")


def blended_layers(spark, sf_dir):
    """Two levels of each cell blended, and where they differ by more than half the range."""
    c = I.cells(spark, sf_dir).select("x", "y", S.stretch(F.col("dx"), F.lit(20.0), F.lit(30.0), 255.0).alias("a"), S.stretch(F.col("dy"), F.lit(4.0), F.lit(6.0), 255.0).alias("b"))
    return serving.blend(c, "a", "b", 0.4).select("x", "y", S.r6(F.col("level")).alias("level"), "apart")


register("blended_layers", blended_layers, f"""
WITH {I.CELLS}, c AS (SELECT x, y, (greatest(20.0, least(30.0, dx)) - 20.0) / (30.0 - 20.0 + 1e-8) * 255.0 AS a, (greatest(4.0, least(6.0, dy)) - 4.0) / (6.0 - 4.0 + 1e-8) * 255.0 AS b FROM cells)
SELECT x, y, round(0.6 * a + 0.4 * b, 6) AS level, abs(a - b) > 127.5 AS apart FROM c""")


def class_listing(spark, sf_dir):
    """A page of a report: the local units by locality, ten after the first five (a report of ten)."""
    return roi_classes(spark, sf_dir).where("class = 'local'").orderBy(F.desc("locality"), "region").offset(5).limit(10).select("region", "inter", "locality")


register("class_listing", class_listing, f"SELECT region, inter, locality FROM ({oracle_sql()['roi_classes']}) WHERE class = 'local' ORDER BY locality DESC, region LIMIT 10 OFFSET 5")


def reconstructed_field(spark, sf_dir):
    """Each band's field as its modes give it back, with what is left."""
    b = G.block_mean(I.field(spark, sf_dir), ["t"], "x", "y", 5, ["dx", "dy"], 40, 25)

    def rebuild(pdf: pd.DataFrame) -> pd.DataFrame:
        y, coords = band_field(pdf)
        m = M.fit_modes(y, coords)
        back = np.einsum("kt,knd->tnd", m.h, m.b)
        months = np.unique(pdf.t)
        t, n = np.indices(y.shape[:2])
        return pd.DataFrame({"band": int(pdf["by"].iloc[0]), "t": months[t.ravel()], "bx": coords[n.ravel(), 0].astype(int), "dx": back[..., 0].ravel().round(6), "dy": back[..., 1].ravel().round(6), "rest": np.hypot(*(y - back).reshape(-1, 2).T).round(6)})

    return b.groupBy("by").applyInPandas(rebuild, "band long, t long, bx long, dx double, dy double, rest double")


register("reconstructed_field", reconstructed_field)


def simulated_cells(spark, sf_dir):
    """Discs that move, a frame for each priority of the orders: seeded by the frame, so any task makes the same."""
    frames = I.table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("long").alias("t")).distinct()

    def draw(batches):
        for pdf in batches:
            for t in pdf.t.tolist():
                a = K.moving_discs((48, 32), 6, t, seed=1)
                x, y = np.nonzero(a)
                yield pd.DataFrame({"t": t, "x": x, "y": y, "v": a[x, y].round(6)})

    return frames.mapInPandas(draw, "t long, x long, y long, v double")


register("simulated_cells", simulated_cells)
