import datetime
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrid.operators import components as C
from kinegrid.operators import grids as G
from kinegrid.operators import windows as W
from kinegrid.streaming import scan


def slow_runs(frames, gap):
    out = []
    for t in sorted(frames):
        if out and t - out[-1][1] <= gap + 1:
            out[-1][1] = t
        else:
            out.append([t, t])
    return [tuple(x) for x in out]


def test_islands_and_unions(spark):
    rng = random.Random(3)
    sets = {k: sorted(rng.sample(range(40), rng.randint(1, 20))) for k in range(12)}
    df = spark.createDataFrame([(k, t) for k, v in sets.items() for t in v], "k int, t int")
    for gap in (0, 2):
        got = {}
        for r in W.islands(df, ["k"], "t", gap).orderBy("t0").collect():
            got.setdefault(r["k"], []).append((r["t0"], r["t1"]))
        assert got == {k: slow_runs(v, gap) for k, v in sets.items()}
    spans = spark.createDataFrame([(0, 1, 9), (0, 2, 3), (0, 11, 12), (0, 10, 10), (1, 5, 6)], "k int, s int, e int")
    got = {(r["k"], r["t0"], r["t1"], r["n"]) for r in W.union_intervals(spans, ["k"], "s", "e").collect()}
    assert got == {(0, 1, 12, 4), (1, 5, 6, 1)}


def test_hit_rate_counts_clipped_windows(spark):
    active = {0: [0, 0, 1, 0, 0, 1], 1: [0] * 6}
    df = spark.createDataFrame([(k, t, bool(a)) for k, v in active.items() for t, a in enumerate(v)], "site int, t int, active boolean")
    events = spark.createDataFrame([(0,), (3,), (4,), (9,)], "start int")
    got = {r["site"]: (r["windows"], r["hits"]) for r in W.hit_rate(df, events, ["site"], "t", "active", 2, 6).collect()}
    assert got == {0: (3, 1), 1: (3, 0)}


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_a_long_chain(spark, monkeypatch, few):
    n = 40
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:])) + [(100, 101)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 100, 101, 200]], "node int")
    monkeypatch.setattr(C, "FEW", few)
    got = {r["node"]: r["component"] for r in C.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 200: 200}


@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=30))
@settings(max_examples=4, deadline=None)
def test_morphology(spark, cells):
    df = spark.createDataFrame([(int(x), int(y)) for x, y in cells], "x long, y long")
    as_set = lambda d: {(r["x"], r["y"]) for r in d.collect()}
    box = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert as_set(G.dilate(df, [])) == {(x + i, y + j) for x, y in cells for i, j in box}
    assert as_set(G.erode(df, [])) == {(x, y) for x, y in cells if all((x + i, y + j) in cells for i, j in box)}


def test_fill_holes_takes_the_nearest(spark):
    rows = [(0, 0, 1.0), (1, 0, None), (2, 0, None), (3, 0, None), (9, 0, None), (4, 0, 5.0)]
    got = {r["x"]: r["v"] for r in G.fill_holes(spark.createDataFrame(rows, "x long, y long, v double"), [], "v", 2).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 3: 5.0, 9: None, 4: 5.0}


def test_scatter_at_a_cell_and_between(spark):
    pts = spark.createDataFrame([(1.0, 1.0, 1.0, 7.0), (0.5, 0.0, 0.0, 2.0)], "px double, py double, pz double, v double")
    got = {(r["x"], r["y"], r["z"]): (r["w"], r["v"]) for r in G.scatter_trilinear(pts, [], "v", 3, 3, 3).collect()}
    assert got == {(1, 1, 1): (1.0, 7.0), (0, 0, 0): (0.5, 2.0), (1, 0, 0): (0.5, 2.0)}


def test_stream_replay_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(s, t, float(rng.normal())) for s in range(4) for t in range(25)]
    src = tmp_path / "in"
    for lo in range(0, 25, 9):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 9], "site long, t long, v double").coalesce(1).write.mode("append").parquet(str(src))
    batch = {(r["site"], r["t"]): tuple(r) for r in scan.scan_batch(spark.createDataFrame(rows, "site long, t long, v double")).collect()}
    files = sorted(src.glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    stage = tmp_path / "stream"
    stage.mkdir()
    for f in files:
        f.rename(stage / f.name)
    stream = spark.readStream.schema("site long, t long, v double").option("maxFilesPerTrigger", 1).parquet(str(stage))
    q = scan.scan_stream(stream).writeStream.format("memory").queryName("scan_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["site"], r["t"]): tuple(r) for r in spark.table("scan_out").collect()} == batch


def streamed(spark, tmp_path, name, parts, schema, **options):
    """The stream's rows over parts that come one micro-batch each."""
    src = tmp_path / "in"
    files = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / str(i)))
        files += sorted((src / str(i)).glob("*.parquet"))
    stage = tmp_path / "stream"
    stage.mkdir()
    for i, f in enumerate(files):
        f.rename(stage / f"{i:03d}.parquet")
        os.utime(stage / f"{i:03d}.parquet", (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(stage))
    q = scan.scan_stream(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect(), q


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    parts = [[(1, 0, 1.0), (1, 2, 3.0)], [(1, 1, 9.0), (1, 2, 9.0), (1, 3, 5.0)]]
    rows, _ = streamed(spark, tmp_path, "late_out", parts, "site long, t long, v double", size=5, chunk=10)
    assert [(r["t"], r["reference"], r["late"]) for r in sorted(rows, key=lambda r: r["t"])] == [(0, 1.0, 0), (2, 1.0, 0), (3, 2.0, 2)]
    batch = scan.scan_batch(spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 1, 4.0)], "site long, t long, v double")).collect()
    assert [(r["t"], r["late"]) for r in batch] == [(0, 0), (1, 1)]


def test_watermark_and_timeout(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    parts = [[(1, 0, 1.0, at(0)), (2, 0, 1.0, at(0))], [(1, 100, 2.0, at(100))], [(1, 101, 2.0, at(101))], [(2, 1, 7.0, at(1)), (2, 102, 4.0, at(102))]]
    rows, q = streamed(spark, tmp_path, "idle_out", parts, "site long, t long, v double, ts timestamp", ts="ts", delay="1 hour", idle="2 hours", chunk=1000)
    got = {(r["site"], r["t"]): (r["reference"], r["late"]) for r in rows}
    assert (2, 1) not in got  # later than the watermark
    assert got[2, 102] == (4.0, 0)  # site 2's state, idle for hours, is gone: its window is empty
    assert got[1, 101] == (1.5, 0) or got[1, 101][0] == 2.0


@pytest.mark.parametrize("small", [0, 10**9])
def test_components_with_hot_nodes(spark, monkeypatch, small):
    """Stars of many leaves, chains between them and loners, with hot nodes broadcast or not."""
    monkeypatch.setattr(C, "FEW", 0)
    monkeypatch.setattr(C, "SMALL", small)
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(1001, 1300)] + [(1299, 2000), (2000, 2001)] + [(5000 + i, 5001 + i) for i in range(0, 60, 2)]
    rng.shuffle(edges)
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in sorted({x for e in edges for x in e} | {9999})], "node long")
    got = {r["node"]: r["component"] for r in C.components(nodes, df).collect()}
    root = {i: i for i in got}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in edges:
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    assert got == {i: find(i) for i in got}
