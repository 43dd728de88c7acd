"""What the jobs share: configurations, the log, and paths that Spark alone opens."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import tomllib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settings(spark: SparkSession, kind: type, path: str | None):
    """The settings dataclass ``kind`` from a TOML file, read by Spark; names it doesn't have, and values of another type, are errors."""
    given = tomllib.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    known = {f.name: f.default for f in dataclasses.fields(kind)}
    for name, value in given.items():
        if name not in known:
            raise ValueError(f"{name}: unknown")
        wants = float if isinstance(known[name], float) else type(known[name])
        if isinstance(value, bool) or not isinstance(value, {float: (int, float), tuple: list}.get(wants, wants)):
            raise ValueError(f"{name}: not a {wants.__name__}")
        given[name] = wants(value)
    return kind(**given)


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or one without rows where nothing has been written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def put(rows: DataFrame, path: str, by: list[str], whole: bool = False) -> None:
    """Replace the partitions that rows have and leave the others, or the ``whole`` table; large partitions become several files, small ones one."""
    mode = "static" if whole else "dynamic"
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(path)


@contextmanager
def joined_by_size(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside broadcast a side by its measured size only. The planner's own estimate takes exploded
    rows to be as few as they were before, and Parquet's columns to be as small as their files."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (planned, measured)}
    spark.conf.set(measured, before[measured] or spark.conf.get(planned))
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def counted(df: DataFrame, what: str, log: logging.Logger, **where) -> int:
    """Rows of what was written, from its files, into the log."""
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    n = df.count()
    log.info("%s: %d rows%s", what, n, "".join(f", {k} {v}" for k, v in where.items()))
    return n


def main(name: str, about: str, kind: type, run: Callable) -> None:
    """Command line of a job: creates the session and stops it."""
    ask = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    ask.add_argument("--input", required=True, help="table to read")
    ask.add_argument("--output", required=True, help="folder of the results, and of the mark where the job keeps one")
    ask.add_argument("--config", help="TOML file of settings")
    given = ask.parse_args()
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("jobs").setLevel(logging.INFO)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, given.input, given.output, settings(spark, kind, given.config))
    finally:
        spark.stop()
