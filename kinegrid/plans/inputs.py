"""The driver's tables as inputs of the operators, and the same inputs as SQL.

Patches are users on a 15-wide grid, frames are days, the signal is the day's sum of values on a zero-filled
spine. A vector field comes from line items on a 40 x 25 grid by month. Feature vectors are embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "2024-01-01"
WIDTH = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """(user_id, keys, t, v): sum of values by day, for days that have any.

    Sums of doubles depend on their order, and equal days must tie at any size: values are added in the order of the
    events, however the table is split. A running sum holds no day's events together."""
    by = ["user_id", *keys, "t"]
    e = table(spark, sf_dir, "events").select("event_id", "user_id", *keys, F.datediff(F.to_date("ts"), F.lit(EPOCH)).alias("t"), "value")
    order = Window.partitionBy(*by).orderBy("event_id")
    so_far = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return e.select(*by, so_far.alias("v"), F.lead(F.lit(1)).over(order).alias("more")).where("more is null").drop("more")


def patches(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> DataFrame:
    """(site, x, y, t, frames, v): a row for each user and day of the table's span.

    The span is one row; the spine is exploded from each user, so nothing is crossed."""
    e = table(spark, sf_dir, "events")
    span = e.agg(F.max(F.datediff(F.to_date("ts"), F.lit(EPOCH))).alias("last"))
    users = e.select("user_id").distinct().join(F.broadcast(span))
    spine = users.select("user_id", (F.col("last") + 1).alias("frames"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t"))
    v = daily(spark, sf_dir) if event_type is None else daily(spark, sf_dir, "event_type").where(F.col("event_type") == event_type).drop("event_type")
    joined = spine.join(v, ["user_id", "t"], "left")
    return joined.select(F.col("user_id").alias("site"), (F.col("user_id") % WIDTH).alias("x"), F.floor(F.col("user_id") / WIDTH).alias("y"), "t", "frames", F.coalesce("v", F.lit(0.0)).alias("v"))


def span(spark: SparkSession, sf_dir: str) -> int:
    """The number of days of the events: read once, when a plan that clips windows to it is made."""
    return table(spark, sf_dir, "events").agg(F.max(F.datediff(F.to_date("ts"), F.lit(EPOCH)))).first()[0] + 1


PATCHES = """
ev AS (SELECT user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, value FROM events),
patches AS (
  SELECT u.user_id AS site, u.user_id % 15 AS x, u.user_id // 15 AS y, s.t, (SELECT max(t) + 1 FROM ev) AS frames, coalesce(d.v, 0.0) AS v
  FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(t) + 1 FROM ev))) AS t) s
  LEFT JOIN (SELECT user_id, t, sum(value) AS v FROM ev GROUP BY ALL) d ON d.user_id = u.user_id AND d.t = s.t
)"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, x, y, dx, dy, n): mean components by month and cell."""
    li = table(spark, sf_dir, "lineitem")
    t = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("long")
    return li.groupBy(t.alias("t"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 25).alias("y")).agg(F.avg("l_quantity").alias("dx"), F.avg(F.col("l_discount") * 100).alias("dy"), F.count("*").alias("n"))


FIELD = """
field AS (
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS t, l_partkey % 40 AS x, l_suppkey % 25 AS y,
    avg(l_quantity) AS dx, avg(l_discount * 100) AS dy, count(*) AS n
  FROM lineitem GROUP BY ALL
)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, dx, dy): the field over all months."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 25).alias("y")).agg(F.avg("l_quantity").alias("dx"), F.avg(F.col("l_discount") * 100).alias("dy"))


CELLS = "cells AS (SELECT l_partkey % 40 AS x, l_suppkey % 25 AS y, avg(l_quantity) AS dx, avg(l_discount * 100) AS dy FROM lineitem GROUP BY ALL)"


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, x, y, z, v): mean quantity by year and cell of a 40 x 25 x 7 volume."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.year("l_shipdate").cast("long").alias("t"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 25).alias("y"), (F.col("l_linenumber") - 1).cast("long").alias("z")).agg(F.avg("l_quantity").alias("v"))


VOLUME = """
volume AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS t, l_partkey % 40 AS x, l_suppkey % 25 AS y, CAST(l_linenumber - 1 AS BIGINT) AS z, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slice, label, p, v): embeddings as slices of 64 pixels."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slice"), "label", F.posexplode("embedding").alias("p", "v")).select("slice", "label", "p", F.col("v").cast("double").alias("v"))


PIXELS = "pixels AS (SELECT vec_id AS slice, label, unnest(range(0, len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def over(*keys: str):
    return Window.partitionBy(*keys)
