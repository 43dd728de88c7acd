"""Response report: how often a site's channels answer within some days of the motion episodes of its region.

One channel of an event log gives the motion: days on which a site's sum is above its rolling robust threshold form
episodes, those of a region's sites are merged, and their first days are the region's onsets. Every other channel of
every site is then asked, lag by lag, how many windows after the onsets hold an active day, what part of all windows
of that length does, and how likely so many hits are at that rate.

    FOLDER/episodes         part=: first and last day of the merged episodes of each region, regions dealt into 16 parts
    FOLDER/responses        channel=: site, lag, windows, hits, rate, baseline, lift, p value

Each table is written from what the one before holds on disk. Reruns replace the episodes whole and the partitions of
the responses, and leave the same tables. Folders follow the parts and channels, never the number of regions.

Cases: rows without a site, a channel or a time are passed over, as are those outside the span; null values count as 0;
sites without events of a channel have silent days in it; where no window fits, a lag gives no row; no events: no rows.
"""

from __future__ import annotations

import datetime
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from kinegrid.functions import scalars
from kinegrid.operators import windows

LOG = logging.getLogger("jobs.response_report")


@dataclass(frozen=True)
class Settings:
    motion: str = "view"
    width: int = 15
    half: int = 5
    scale: float = 2.0
    close: int = 1
    extend: int = 1
    window: int = 3
    lags: tuple = (-2, -1, 0, 1, 2, 3)
    since: str = "2024-01-01"
    until: str = ""


PARTS = 16
EPISODES = "t0 long, t1 long, units long, roi long, part long"
RESPONSES = "site long, roi long, lag long, windows long, hits long, rate double, baseline double, lift double, p_value double, channel string"


def daily(events: DataFrame, since: str) -> DataFrame:
    """(channel, site, t, v): sums by day."""
    t = F.datediff(F.to_date("ts"), F.lit(since).cast("date")).alias("t")
    rows = events.select(F.col("event_type").alias("channel"), F.col("user_id").cast("long").alias("site"), t, F.coalesce("value", F.lit(0.0)).alias("value"))
    return rows.where("channel is not null and site is not null and t >= 0").groupBy("channel", "site", "t").agg(F.sum("value").alias("v"))


def spine(sums: DataFrame, channels: list[str], frames: int) -> DataFrame:
    """(channel, site, t, v): a row for each day and site of the given channels; days without events are 0."""
    sites = sums.select("site").distinct().withColumn("channel", F.explode(F.lit(channels).cast("array<string>")))
    days = sites.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return days.join(sums, ["channel", "site", "t"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def episodes(sums: DataFrame, frames: int, config: Settings) -> DataFrame:
    """(roi, t0, t1, units) of the motion channel."""
    motion = spine(sums, [config.motion], frames)
    units = windows.motion_units(motion, ["site"], "t", "v", F.lit(frames), config.half, config.scale, config.close, config.extend)
    of = units.select(F.floor(F.col("site") / config.width).alias("roi"), "t0", "t1")
    merged = windows.union_intervals(of, ["roi"], "t0", "t1", 0)
    return merged.select(F.col("t0").cast("long").alias("t0"), F.col("t1").cast("long").alias("t1"), F.col("n").alias("units"), F.col("roi").cast("long").alias("roi"))


def responses(sums: DataFrame, found: DataFrame, frames: int, config: Settings) -> DataFrame:
    """The responses of all channels but the motion's to the onsets of ``found``."""
    others = [r["channel"] for r in sums.where(F.col("channel") != config.motion).select("channel").distinct().collect()]  # a handful of names
    LOG.info("channels: %s", ", ".join(sorted(others)))
    series = spine(sums, sorted(others), frames).select("channel", "site", F.floor(F.col("site") / config.width).cast("long").alias("roi"), "t", (F.col("v") > 0).alias("active"))
    lag = F.explode(F.array(*(F.lit(k).cast("long") for k in config.lags))).alias("lag")
    starts = found.select("roi", F.col("t0"), lag).select("roi", "lag", (F.col("t0") + F.col("lag")).alias("start")).where(f"start >= 0 and start < {frames}")
    hit = windows.hit_rate(series, starts, ["channel", "site"], "t", "active", config.window, frames, ["roi"], ["lag"])
    base = windows.window_probability(series, ["channel", "site"], "t", "active", config.window)
    both = hit.join(base, ["channel", "site"])
    rate = F.col("hits") / F.col("windows")
    return both.select(
        "site", F.floor(F.col("site") / config.width).cast("long").alias("roi"), "lag", F.col("windows").cast("long").alias("windows"), F.col("hits").cast("long").alias("hits"),
        F.round(rate, 6).alias("rate"), F.round("prob", 6).alias("baseline"), F.round(rate - F.col("prob"), 6).alias("lift"),
        F.round(scalars.binomial_tail(F.col("hits"), F.col("windows"), F.col("prob")), 6).alias("p_value"), "channel",
    )


def run(spark: SparkSession, source: str, output: str, config: Settings = Settings()) -> DataFrame:
    """Write the report of ``source`` into ``output``; the whole responses table."""
    events = spark.read.parquet(source).select("ts", "user_id", "event_type", "value")
    if config.until:
        events = events.where(F.to_date("ts") < F.lit(config.until).cast("date"))
    sums = daily(events, config.since)
    read, last = events.agg(F.count("*"), F.max(F.to_date("ts"))).first()
    LOG.info("%s: %d rows, last day %s", source, read, last)
    end = datetime.date.fromisoformat(config.until) if config.until else last + datetime.timedelta(days=1) if last else None
    frames = (end - datetime.date.fromisoformat(config.since)).days if end else 0
    at, to = f"{output}/episodes", f"{output}/responses"
    if frames > 0 and read:
        common.put(episodes(sums, frames, config).withColumn("part", F.pmod("roi", F.lit(PARTS))), at, ["part"], whole=True)
        found = common.existing(spark, at, EPISODES)
        common.counted(found, at, LOG)
        common.put(responses(sums, found, frames, config), to, ["channel"])
    result = common.existing(spark, to, RESPONSES)
    common.counted(result, to, LOG)
    return result


if __name__ == "__main__":
    common.main("response_report", __doc__.splitlines()[0], Settings, run)
