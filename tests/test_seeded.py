"""The seeded scan: any cut into micro-batches, any order, restarts, waits, and states that expire, against the batch."""

import os
import random
import time

import pytest

from kinegrid.streaming import seeded as D

FRAMES = "site long, direction long, step long, v double"


@pytest.fixture(scope="module")
def recording(spark):
    rng = random.Random(5)
    rows = [(s, t, round(rng.gauss(10, 3), 3)) for s in (1, 2, 3) for t in range(30)] + [(4, t, float(t)) for t in range(17, 23)]
    df = spark.createDataFrame(rows, "site long, t long, v double")
    return D.steps(df, (13, 17)), D.seeds(df, (13, 17))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def slow(frames, seed, size=3, chunk=5, decay=0.7):
    """By definition: references from the corrections of the chunk before."""
    out = []
    for key in sorted({r[:2] for r in frames}):
        own = dict(r[2:] for r in frames if r[:2] == key)
        before, motion = [v for i, v in sorted(r[2:] for r in seed if r[:2] == key)][-size:], 0.0
        for c in range(max(own) // chunk + 1):
            here = [k for k in sorted(own) if k // chunk == c]
            if not here:
                continue
            reference, corrected = sum(before) / len(before) if before else own[here[0]], []
            for k in here:
                motion = decay * motion + (1 - decay) * (own[k] - reference)
                corrected.append(own[k] - motion)
                out.append((*key, k, c, reference, motion, corrected[-1]))
            before = corrected[-size:]
    return out


def test_batch_by_definition(recording):
    frames, seed = recording
    want = slow([tuple(r) for r in frames.collect()], [tuple(r) for r in seed.collect()])
    got = rows_of(D.scan_batch(frames, seed))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    assert len(got) == 3 * 26 + 6  # site 4 has frames ahead alone, and no seed


def run(spark, tmp_path, parts, seed, out="out", **options):
    """Feed the parts, a micro-batch each, in the runs given (a list of runs of parts); all rows so far."""
    stage = tmp_path / "stage"
    stage.mkdir(exist_ok=True)
    at = len(list(stage.iterdir()))
    for i, part in enumerate(parts, at):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (f,) = (tmp_path / f"p{i}").glob("*.parquet")
        f.rename(stage / f"{i:03d}.parquet")
        os.utime(stage / f"{i:03d}.parquet", (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(stage))
    with D.with_rocksdb(spark):
        q = D.scan_stream(stream, seed, **options).writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return rows_of(spark.read.schema(D.OUT).parquet(str(tmp_path / out)))


@pytest.mark.parametrize("cut", ["one", "many", "shuffled"])
def test_any_cut_equals_the_batch(spark, recording, tmp_path, cut):
    frames, seed = recording
    rows = sorted((tuple(r) for r in frames.collect()), key=lambda r: r[2])
    if cut == "shuffled":  # frames before their turn wait in state
        random.Random(1).shuffle(rows)
    parts = [rows] if cut == "one" else [rows[i : i + 17] for i in range(0, len(rows), 17)]
    assert run(spark, tmp_path, parts, seed) == rows_of(D.scan_batch(frames, seed))
    assert spark.conf.get(D.PROVIDER, None) != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_restart_from_the_checkpoint(spark, recording, tmp_path):
    """The second run goes on from the states of the first; the seed is taken once."""
    frames, seed = recording
    rows = sorted((tuple(r) for r in frames.collect()), key=lambda r: (r[2], r[0]))
    want = rows_of(D.scan_batch(frames, seed))
    first = run(spark, tmp_path, [rows[:31]], seed)
    assert 0 < len(first) < len(want) and set(first) < set(want)
    assert run(spark, tmp_path, [rows[31:50], rows[50:]], seed) == want


class Clocked:
    """A query that keeps running, fed part by part."""

    def __init__(self, spark, tmp_path, seed, **options):
        self.spark, self.root = spark, tmp_path
        (tmp_path / "stage").mkdir()
        stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stage"))
        with D.with_rocksdb(spark):
            to = D.scan_stream(stream, seed, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            self.query, self.n = to.trigger(processingTime="0 seconds").start(), 0

    def feed(self, rows):
        self.spark.createDataFrame(rows, FRAMES).coalesce(1).write.parquet(str(self.root / f"p{self.n}"))
        (f,) = (self.root / f"p{self.n}").glob("*.parquet")
        f.rename(self.root / "stage" / f"{self.n:03d}.parquet")
        self.n += 1

    def rows(self, enough, seconds=40):
        """What is there as soon as ``enough`` holds of it."""
        end = time.monotonic() + seconds
        while True:
            found = rows_of(self.spark.read.schema(D.OUT).parquet(str(self.root / "out")))
            if enough(found) or time.monotonic() > end or not self.query.isActive:
                return found
            time.sleep(0.3)


SEED = "site long, direction long, i long, v double"


def test_missing_and_late_frames(spark, tmp_path):
    """A gap holds what follows until the wait is over; a frame that comes after that is dropped."""
    seed = spark.createDataFrame([(1, 1, 0, 5.0)], SEED)
    row = lambda k: (1, 1, k, float(k))
    q = Clocked(spark, tmp_path, seed, patience=4000)
    try:
        q.feed([row(0), row(1), row(3)])
        assert [r[2] for r in q.rows(lambda x: len(x) >= 2)] == [0, 1]
        assert [r[2] for r in q.rows(lambda x: len(x) >= 3)] == [0, 1, 3]
        q.feed([row(2), row(4)])
        got = q.rows(lambda x: len(x) >= 4)
    finally:
        q.query.stop()
    assert got == rows_of(D.scan_batch(spark.createDataFrame([row(k) for k in (0, 1, 3, 4)], FRAMES), seed))


def test_idle_keys_lose_their_states(spark, tmp_path):
    q = Clocked(spark, tmp_path, spark.createDataFrame([(1, 1, 0, 5.0)], SEED), idle=500)
    try:
        q.feed([(1, 1, 0, 8.0)])
        assert len(q.rows(lambda x: len(x) >= 1)) == 1
        time.sleep(1.5)
        q.feed([(1, 1, 0, 9.0)])
        got = q.rows(lambda x: len(x) >= 2)
    finally:
        q.query.stop()
    assert [r[4] for r in got if r[6] == 9.0] == [9.0]  # as a key without a seed: its frame is its reference


def test_late_frames_of_a_query_that_ends(spark, tmp_path):
    seed = spark.createDataFrame([(1, 1, 0, 5.0)], SEED)
    got = run(spark, tmp_path, [[(1, 1, 0, 1.0), (1, 1, 1, 2.0)], [(1, 1, 0, 7.0), (1, 1, 1, 7.0), (1, 1, 2, 3.0), (1, 1, 4, 9.0)]], seed)
    assert got == rows_of(D.scan_batch(spark.createDataFrame([(1, 1, k, k + 1.0) for k in range(3)], FRAMES), seed))


def test_states_are_those_of_many_sites(spark, tmp_path):
    """The store is called for a bundle, not for each site; rows are those of the batch, whatever the ids."""
    rng, sites = random.Random(9), [*range(130), -3, 2**40]
    rows = [(s, t, round(rng.gauss(10, 3), 3)) for s in sites for t in range(12)]
    df = spark.createDataFrame(rows, "site long, t long, v double")
    frames, seed = D.steps(df, (4, 7)), D.seeds(df, (4, 7))
    shuffled = [tuple(r) for r in frames.collect()]
    rng.shuffle(shuffled)
    got = run(spark, tmp_path, [shuffled[:500], shuffled[500:]], seed)
    assert got == rows_of(D.scan_batch(frames, seed)) and len(got) == 9 * len(sites)
    keys = spark.read.format("statestore").option("stateVarName", "carries").load(str(tmp_path / "cp")).select("key").distinct().count()
    assert keys == 2 * 5  # both directions of 0-63, 64-127, 128 and 129, and the two by themselves


def test_a_site_waits_without_its_neighbours(spark, tmp_path):
    """Input of a site neither ends nor prolongs the wait of another."""
    q = Clocked(spark, tmp_path, spark.createDataFrame([(1, 1, 0, 5.0), (2, 1, 0, 5.0)], SEED), patience=4000)
    try:
        q.feed([(1, 1, 0, 1.0), (1, 1, 2, 1.0)])
        q.rows(lambda x: len(x) >= 1)
        for k in range(10):
            q.feed([(2, 1, k, 1.0)])
            got = q.rows(lambda x, k=k: (2, k) in {(r[0], r[2]) for r in x})
            if k == 0:
                assert [(r[0], r[2]) for r in got] == [(1, 0), (2, 0)]
            time.sleep(0.5)
        got = {(r[0], r[2]) for r in q.rows(lambda x: False, 0)}
    finally:
        q.query.stop()
    assert got == {(1, 0), (1, 2)} | {(2, k) for k in range(10)}


def test_a_site_expires_without_its_neighbours(spark, tmp_path):
    q = Clocked(spark, tmp_path, spark.createDataFrame([(k, 1, 0, 5.0) for k in (1, 2, 70)], SEED), idle=8000)
    try:
        q.feed([(70, 1, 0, 8.0), (1, 1, 0, 8.0), (2, 1, 0, 8.0)])  # the first batch is slow: the clock is taken from the next
        assert len(q.rows(lambda x: len(x) >= 3)) == 3
        q.feed([(1, 1, 1, 8.0), (2, 1, 1, 8.0)])
        assert len(q.rows(lambda x: len(x) >= 5)) == 5
        time.sleep(3)
        q.feed([(2, 1, 2, 8.0)])
        assert len(q.rows(lambda x: len(x) >= 6)) == 6
        time.sleep(3.5)
        q.feed([(1, 1, 0, 9.0), (2, 1, 3, 9.0)])
        got = [r for r in q.rows(lambda x: len(x) >= 8) if r[0] < 70]
    finally:
        q.query.stop()
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert [r[4] for r in got if r[0] == 1] == [5.0, 9.0, 5.0] and [r[4] for r in got if r[0] == 2] == [5.0] * 4
