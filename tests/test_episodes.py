"""Episodes and artifact rules against brute force and the cases that the rules are for."""

import math
import random

import numpy as np
import pytest

from kinegrid.operators import episodes as E

UNITS = "x long, y long, t0 long, t1 long"


def brute_members(units, tolerance, reach, overlap, least):
    masks, sizes = {}, {}
    for x, y, a, b in units:
        masks.setdefault((a, b), set()).add((x, y))
        sizes[a, b] = sizes.get((a, b), 0) + 1
    spans = sorted(masks)
    root = {s: s for s in spans}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(spans):
        wide = {(x + dx, y + dy) for x, y in masks[a] for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if abs(dx) + abs(dy) <= reach}
        for b in spans[i + 1 :]:
            near = abs(a[0] - b[0]) <= tolerance and abs(a[1] - b[1]) <= tolerance
            if near and min(sizes[a], sizes[b]) >= least and len(wide & masks[b]) / min(len(masks[a]), len(masks[b])) > overlap:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {s: find(s) for s in spans}


@pytest.mark.parametrize(("tolerance", "reach", "overlap", "least"), [(1, 3, 0.3, 1), (2, 1, 0.5, 2), (0, 0, 0.0, 1), (1, 1, 0.3, 3)])
def test_members_against_brute_force(spark, tolerance, reach, overlap, least):
    rng = random.Random(tolerance + reach)
    units = [(rng.randrange(14), rng.randrange(14), t := rng.randrange(9), t + rng.randrange(4)) for _ in range(220)]
    units = sorted(set(units))
    df = spark.createDataFrame([(*u, 1, 5) for u in units], UNITS + ", node long, n long")
    key = lambda s: (s[0] << 32) + s[1]
    want = {key(s): key(e) for s, e in brute_members(units, tolerance, reach, overlap, least).items()}
    of = E.members(df, tolerance, reach, overlap, least)
    assert {r["node"]: r["episode"] for r in of.collect()} == want
    total = E.summary(df, of, 1).collect()
    assert sum(r["area"] for r in total) == len(units) and len(total) == len(set(want.values()))


def test_far_apart_is_not_one_episode(spark):
    """Two groups of neighbouring spans at two ends of the grid, and one that bridges them in time and not in space."""
    left, right = [(x, y) for x in range(3) for y in range(3)], [(x, y) for x in range(20, 23) for y in range(3)]
    units = [(*c, 0, 5) for c in left] + [(*c, 1, 5) for c in right] + [(*c, 1, 6) for c in left]
    of = {r["node"]: r["episode"] for r in E.members(spark.createDataFrame(units, UNITS)).collect()}
    assert of[(1 << 32) + 6] == of[5] != of[(1 << 32) + 5]


def test_whole_body_motion_is_an_artifact(spark):
    """Nine inner cells that move as all others do go; nine with a motion of their own stay."""
    cells, frames = [(x, y) for x in range(20) for y in range(20)], 40
    whole = [5 * math.sin(2 * math.pi * t / frames) for t in range(frames)]
    mine = lambda x, y: 4 <= x < 7 and 4 <= y < 7
    motion = [(x, y, t, -2.0 * t % 7 if mine(x, y) else whole[t]) for x, y in cells for t in range(frames)]
    units = [(x, y, 0, frames - 1) for x in range(10, 13) for y in range(10, 13)]
    units += [(x, y, 3, 30) for x, y in cells if mine(x, y)] + [(x, 0, 5, 20) for x in range(20)] + [(15, 15, 5, 5)] + [(x, y, 0, 33) for x, y in cells if x < 11]
    df = spark.createDataFrame(units, UNITS)
    of = E.members(df, reach=0, overlap=0.99)
    m = spark.createDataFrame(motion, "x long, y long, t long, v double")
    got = {(r["t0"], r["t1"]): r for r in E.artifacts(df, of, m, 1).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {(0, 39): "global", (3, 30): "kept", (5, 20): "global", (5, 5): "short", (0, 33): "fov"}
    assert got[0, 39]["corr"] == pytest.approx(1.0)
    own, all_of = [-2.0 * t % 7 for t in range(3, 31)], whole[3:31]
    assert got[3, 30]["corr"] == pytest.approx(np.corrcoef(own, all_of)[0, 1])
    loose = {(r["t0"], r["t1"]): r["reason"] for r in E.artifacts(df, of, m, 1, most_corr=None, longest=30).collect()}
    assert loose == {(0, 39): "long", (3, 30): "kept", (5, 20): "edge", (5, 5): "short", (0, 33): "fov"}


def test_edge_cells(spark):
    valid = {(x, y) for x in range(8) for y in range(9)} - {(4, 4)}
    out = lambda x, y, w: any((x + i, y + j) not in valid for i in range(-w, w + 1) for j in range(-w, w + 1) if i * i + j * j <= w * w)
    df = spark.createDataFrame(sorted(valid), "x long, y long")
    for w in (1, 2):
        assert {(r["x"], r["y"]) for r in E.edge_cells(df, w).collect()} == {c for c in valid if out(*c, w)}
    assert E.members(spark.createDataFrame([], UNITS)).collect() == []
