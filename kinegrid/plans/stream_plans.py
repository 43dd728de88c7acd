"""Scans over the patch series: the rolling one in its batch form, the seeded one as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_folder
from ..streaming import seeded as D
from ..streaming.scan import scan_batch
from . import inputs as I
from .registry import register


def directional_scan(spark, sf_dir):
    p = I.patches(spark, sf_dir).select("site", F.col("t").cast("long").alias("t"), "v")
    return scan_batch(p).select("site", "t", "chunk", *(F.round(c, 6).alias(c) for c in ("reference", "residual", "warm")))


register("directional_scan", directional_scan, f"""
WITH RECURSIVE {I.PATCHES}, p AS (SELECT site, CAST(t AS BIGINT) AS t, v, list(v) OVER (PARTITION BY site, t // 10 ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS w FROM patches),
f AS (SELECT site, t, v, coalesce(list_sum(w) / len(w), v) AS reference FROM p),
s AS (SELECT site, t, t // 10 AS chunk, reference, v - reference - 0.0 AS residual, 0.7 * (0.0 + v - reference - 0.0) AS warm FROM f WHERE t = 0
  UNION ALL SELECT f.site, f.t, f.t // 10, f.reference, f.v - f.reference - s.warm, 0.7 * (s.warm + (f.v - f.reference - s.warm)) FROM s JOIN f ON f.site = s.site AND f.t = s.t + 1)
SELECT site, t, chunk, round(reference, 6) AS reference, round(residual, 6) AS residual, round(warm, 6) AS warm FROM s""")


def seeded_scan(spark, sf_dir):
    """The scan from the middle of every series both ways, as a stream over frames in the order of their distance from it."""
    root = fresh_folder(spark, "seeded")
    p = I.patches(spark, sf_dir).select("site", F.col("t").cast("long").alias("t"), "v", "frames")
    middle = p.agg(F.floor(F.max("frames") / 2)).first()[0]
    frames, seed = D.steps(p, (middle - 2, middle + 2)), D.seeds(p, (middle - 2, middle + 2))
    part = F.floor(F.col("step") / 4).cast("int").alias("part")  # a file for each four steps: the stream's cuts
    frames.select("*", part).repartitionByRange(4, "part").write.parquet(f"{root}/frames")
    stream = spark.readStream.schema("site long, direction long, step long, v double").option("maxFilesPerTrigger", 2).parquet(f"{root}/frames")
    seed.write.parquet(f"{root}/seed")
    with D.with_rocksdb(spark):
        rows = D.scan_stream(stream, spark.read.parquet(f"{root}/seed"))
        query = rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema(D.OUT).parquet(f"{root}/out")
    return found.select("site", "direction", "step", "chunk", *(F.round(c, 6).alias(c) for c in ("reference", "motion", "corrected")))


register("seeded_scan", seeded_scan, f"""
WITH RECURSIVE {I.PATCHES}, mid AS (SELECT max(frames) // 2 AS m FROM patches),
f AS (SELECT site, 1 AS direction, t - (m + 2) AS step, v FROM patches, mid WHERE t >= m + 2 UNION ALL SELECT site, -1, m - 3 - t, v FROM patches, mid WHERE t < m - 2),
b AS (SELECT site, d.direction, list(v ORDER BY t * d.direction)[-3:] AS w FROM patches, mid, (VALUES (1), (-1)) d(direction) WHERE t >= m - 2 AND t < m + 2 GROUP BY ALL),
s AS (
  SELECT f.site, f.direction, CAST(0 AS BIGINT) AS step, list_sum(w) / len(w) AS reference, (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * (v - list_sum(w) / len(w)) AS motion, [v - (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * (v - list_sum(w) / len(w))] AS held
  FROM f JOIN b ON b.site = f.site AND b.direction = f.direction WHERE f.step = 0
  UNION ALL
  SELECT site, direction, step, reference, motion, list_append(CASE WHEN step % 5 = 0 THEN [] ELSE held END, v - motion)[-3:]
  FROM (SELECT site, direction, step, v, held, reference, CAST(0.7 AS DOUBLE) * motion + (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * (v - reference) AS motion
    FROM (SELECT f.site, f.direction, f.step, f.v, held, motion, CASE WHEN f.step % 5 = 0 THEN list_sum(held) / len(held) ELSE reference END AS reference
      FROM s JOIN f ON f.site = s.site AND f.direction = s.direction AND f.step = s.step + 1)))
SELECT site, CAST(direction AS BIGINT) AS direction, step, step // 5 AS chunk, round(reference, 6) AS reference, round(motion, 6) AS motion, round(held[-1], 6) AS corrected FROM s""")
