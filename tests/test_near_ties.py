"""Days and limits that differ in the last digit only: the rows must be those of the SQL, or of sums by day, however the table is split."""

import datetime
import math
import random
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import add

import duckdb
import pytest

from kinegrid.plans import registry

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def against_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet' order by event_id")
    df = registry.queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def day(i, t, user, value):
    return (i, datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(days=t), user, "view", float(value), "")


@pytest.mark.parametrize("seed", [1, 2])
def test_a_limit_between_neighbouring_doubles(spark, tmp_path, seed):
    rng, rows = random.Random(seed), []
    for user in range(150):
        lo = hi = round(rng.random() * 500, 2)
        for _ in range(rng.randint(0, 3)):
            hi = math.nextafter(hi, 1e9)
        rows += [day(len(rows) + t, t, user, v) for t, v in enumerate([1.0] * 27 + [lo + 2, math.nextafter(hi + 2, 1e9), hi + 100])]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    against_sql(spark, "robust_mean_std", tmp_path)


def test_equal_days_of_split_tables(spark, tmp_path):
    rng, rows = random.Random(3), []
    for user in range(200):
        values = [round(rng.random() * 100, 2) for _ in range(6)]
        for t in (3, 9):  # two days of the same values in another order
            rng.shuffle(values)
            rows += [(t, user, v) for v in values]
        rows.append((20, user, 1.0))
    rng.shuffle(rows)
    rows = [day(i, *r) for i, r in enumerate(sorted(rows, key=lambda r: r[0]))]
    spark.createDataFrame(rows, EVENTS).repartition(16, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    against_sql(spark, "temporal_basis", tmp_path)


def split_sum(rng, total, n, least):
    """n numbers of cents, each over ``least``, that add up to total."""
    cuts = sorted(rng.sample(range(total - n * least - n), n - 1))
    return [b - a + least + 1 for a, b in zip([0, *cuts], [*cuts, total - n * least - n], strict=True)]


def written(spark, folder, days):
    """days: {user: cents of days 0, 1, ...}; the parts of the table hold days in no order."""
    rows = [day(i, t, user, cents / 100) for i, (t, user, cents) in enumerate(sorted((t, u, c) for u, values in days.items() for t, c in enumerate(values)))]
    spark.createDataFrame(rows, EVENTS).repartition(16, "event_id").write.parquet(f"{folder}/events.parquet")


@pytest.fixture
def dealt(spark):
    """Small tables are joined and added as large ones are, in several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_parts_halfway_between_two_digits(dealt, tmp_path):
    rng, days = random.Random(4), {}
    for user in range(600):  # an odd number of cents of 160.00 is a part halfway between two sixth decimals
        peak = rng.randrange(3001, 6000, 2)
        days[user] = [peak, *split_sum(rng, 16000 - peak, 29, 0)]
        rng.shuffle(days[user])
    written(dealt, tmp_path, days)
    part = lambda v: Decimal(repr(max(v) / 100 / reduce(add, [c / 100 for c in v])))
    want = {user: float(part(v).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for user, v in days.items()}
    assert {r["site"]: r["peak_frac"] for r in registry.queries()["temporal_basis"](dealt, str(tmp_path)).collect()} == want


def test_sums_at_the_limit(dealt, tmp_path):
    rng = random.Random(5)
    days = {user: split_sum(rng, 200000, 12, 10000) for user in range(600)}
    written(dealt, tmp_path, days)
    want = {user for user, v in days.items() if reduce(add, [c / 100 for c in v]) >= 2000}
    assert len(want) < 600 and {r["site"] for r in registry.queries()["filtered_regions"](dealt, str(tmp_path)).collect()} == want
