"""Growth, smoothing, energy and sketches against brute force and dense solutions."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinegrid.operators import components as C
from kinegrid.operators import gram as M
from kinegrid.operators import grids as G
from kinegrid.operators import growth as W
from kinegrid.operators import maxtree as T
from kinegrid.operators import regularise as Z
from kinegrid.operators import sketches as K


def slow_growth(seeds, allowed, offsets, steps):
    out, frontier = {}, {}
    for label, *c in seeds:
        if tuple(c) in allowed:
            frontier[tuple(c)] = min(label, frontier.get(tuple(c), label))
    for k in range(steps + 1):
        out |= {c: (label, k) for c, label in frontier.items()}
        new = {}
        for c, label in frontier.items():
            for o in offsets:
                n = tuple(a + b for a, b in zip(c, o, strict=True))
                if n in allowed and n not in out:
                    new[n] = min(label, new.get(n, label))
        frontier = new
    return out


@pytest.mark.parametrize(("radius", "ratio", "steps"), [(1, 1.0, 4), (2, 2.0, 5), (1, 0.5, 3), (2, 1.0, 0)])
def test_growth(spark, radius, ratio, steps):
    rng = random.Random(steps)
    allowed = {c for c in product(range(14), range(12), range(6)) if rng.random() < 0.6}
    seeds = [(rng.randrange(50), rng.randrange(14), rng.randrange(12), rng.randrange(6)) for _ in range(9)] + [(3, 99, 0, 0)]
    offsets = W.ball(radius, ratio)
    found = W.grow(spark.createDataFrame(seeds, "label long, x long, y long, z long"), spark.createDataFrame(sorted(allowed), "x int, y int, z int"), offsets, steps)
    rows = found.collect()
    assert {(r["x"], r["y"], r["z"]): (r["label"], r["step"]) for r in rows} == slow_growth(seeds, allowed, offsets, steps) and len(rows) == len({tuple(r)[:3] for r in rows})


def test_walls_hold_growth(spark):
    """A wall of cells that are not allowed is gone around, never through; nothing grows from nothing."""
    allowed = [(x, y, 0) for x in range(7) for y in range(5) if x != 3 or y == 4]
    a = spark.createDataFrame(allowed, "x long, y long, z long")
    grown = W.grow(spark.createDataFrame([(1, 2, 0, 0)], "label long, x long, y long, z long"), a, W.ball(1), 9)
    steps = {(r["x"], r["y"]): r["step"] for r in grown.collect()}
    assert steps[3, 4] == 5 and steps[4, 4] == 6 and steps[4, 1] == 9 and (4, 0) not in steps
    assert W.grow(spark.createDataFrame([], "label long, x long, y long, z long"), a, W.ball(1), 3).collect() == []


def test_balls():
    """Isotropic in physical space: a coarser z reaches fewer steps, a finer one more."""
    for radius, ratio in ((1, 1.0), (2, 2.0), (3, 0.5), (2, 10.0)):
        got = set(W.ball(radius, ratio))
        assert all(i * i + j * j + (k * ratio) ** 2 <= radius**2 + 1e-6 for i, j, k in got) and (0, 0, 0) not in got
        assert max(k for *_, k in got) == int(radius / ratio + 1e-9)
    for bad in (0.0, float("nan"), float("inf"), -1.0):
        with pytest.raises(ValueError):
            W.ball(1, bad)


def slow_rounds(mu, conf, lam, rounds, eps=1e-6):
    z = mu.copy()
    for _ in range(rounds):
        p = np.pad(z, 1, mode="edge")
        z = (conf * mu + lam * (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:])) / (conf + 4 * lam + eps)
    return z


def table(spark, mu, conf):
    rows = [(x, y, float(mu[x, y]), float(conf[x, y])) for x in range(mu.shape[0]) for y in range(mu.shape[1])]
    return spark.createDataFrame(rows, "x long, y long, mu double, conf double")


def test_rounds_of_smoothing(spark):
    rng = np.random.default_rng(4)
    mu, conf = rng.normal(size=(11, 7)), rng.random((11, 7))
    for rounds in (1, 9, 40):
        got = {(r["x"], r["y"]): r["z"] for r in Z.smoothed(table(spark, mu, conf), 0.7, rounds).collect()}
        want = slow_rounds(mu, conf, 0.7, rounds)
        assert len(got) == 77 and all(v == pytest.approx(want[k], abs=1e-12) for k, v in got.items())


def test_smoothing_solves_the_system(spark):
    """Run until nothing moves, it is the dense solution; cells without a value are filled by their neighbours."""
    rng = np.random.default_rng(5)
    mu, conf = rng.normal(size=(6, 5)), rng.random((6, 5)) + 0.5
    conf[2, 2] = 0.0
    n = mu.size
    a, at = np.zeros((n, n)), lambda x, y: x * 5 + y
    for x, y in product(range(6), range(5)):
        a[at(x, y), at(x, y)] += conf[x, y] + 1e-6
        for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            if 0 <= x + i < 6 and 0 <= y + j < 5:
                a[at(x, y), at(x, y)] += 0.3
                a[at(x, y), at(x + i, y + j)] -= 0.3
    want = np.linalg.solve(a, (conf * mu).ravel())
    df = table(spark, mu, conf).withColumn("mu", F.when((F.col("x") == 2) & (F.col("y") == 2), None).otherwise(F.col("mu")))
    got = {(r["x"], r["y"]): r["z"] for r in Z.smoothed(df, 0.3, 200, tolerance=1e-9, every=20).collect()}
    assert all(v == pytest.approx(want[at(*k)], abs=1e-7) for k, v in got.items())


def test_energy_of_a_million_rows(spark):
    """10^6 rows of 64 numbers made by Spark; products are sums of whole numbers, so exact."""
    n, width = 1_000_000, 64
    entries = F.array(*((F.col("id") * (2 * i + 1) % 7 - F.lit(i % 3)).cast("double") for i in range(width)))
    found = M.gram(spark.range(n, numPartitions=8).select(entries.alias("a")), "a", width)
    k = np.arange(n)[:, None] * (2 * np.arange(width) + 1) % 7 - np.arange(width) % 3
    want = np.zeros((width, width))
    for lo in range(0, n, 100_000):
        want += k[lo : lo + 100_000].astype(float).T @ k[lo : lo + 100_000]
    got = {(r["i"], r["j"]): r["g"] for r in found.collect()}
    assert len(got) == width * (width + 1) // 2 and all(want[i, j] == v for (i, j), v in got.items())
    assert np.allclose(M.energies(found, width), np.maximum(np.linalg.eigvalsh(want)[::-1], 0), atol=1e-3)


def test_ranks_by_energy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 8)) + 1e-6 * rng.normal(size=(300, 8))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [(None,), ([1.0] * 7 + [None],)], "a array<double>")
    energy = M.energies(M.gram(df, "a", 8), 8)
    s = np.linalg.svd(x, compute_uv=False) ** 2
    assert np.allclose(energy, s, rtol=1e-6, atol=1e-6)
    assert [M.rank_for(energy, p) for p in (0.0, 0.5, 1 - 1e-9)] == [1, int(np.searchsorted(np.cumsum(s) / s.sum(), 0.5) + 1), 3]
    assert M.rank_for(np.zeros(4), 0.9) == 0 and M.rank_for(energy, 1.0, 2) == 2
    with pytest.raises(PySparkException, match="8 entries"):
        M.gram(spark.createDataFrame([([1.0],)], "a array<double>"), "a", 8).collect()
    assert M.energies(M.gram(df.limit(0), "a", 8), 8).tolist() == [0.0] * 8


def test_limits_of_ranges(spark):
    """Ranks are off by no more than the bound, over frames of very different sizes and values, with ties."""
    rng = np.random.default_rng(7)
    rows = [(t, float(v)) for t in range(12) for v in (rng.gamma(1 + t, 3, 40 * (t % 4) ** 3 + 5) if t % 5 else np.round(rng.normal(0, 2, 6000)))]
    df = spark.createDataFrame([*rows, (3, None), (4, float("nan")), (20, None)], "t long, v double")
    sketches = K.frame_sketches(df, "t", "v", 200)
    assert sketches.count() == 12
    at, ranges = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0], [(0, 12), (3, 4), (2, 9), (11, 40), (30, 40), (5, 5)]
    got = {(r["first"], r["after"]): r for r in K.range_limits(sketches, spark.createDataFrame(ranges, "first long, after long"), "t", at, 200).collect()}
    assert set(got) == {(0, 12), (3, 4), (2, 9), (11, 40)}
    for (lo, hi), r in got.items():
        v = np.array([x for t, x in rows if lo <= t < hi])
        assert r["n"] == len(v) and (r["low"], r["high"]) == (v.min(), v.max())
        for q, limit in zip(at, r["limits"], strict=True):
            assert (v < limit).mean() - K.rank_error(200) <= q <= (v <= limit).mean() + K.rank_error(200)
    assert K.rank_error(800) < K.rank_error(200) < 0.02


def test_forest_has_the_components_of_all_edges(spark):
    """Equal to a components run at each of 20 thresholds, ties and holes included; the tree's areas, peaks and parents add up."""
    rng = random.Random(9)
    grid = {(x, y): float(rng.randrange(25)) for x in range(20) for y in range(15) if rng.random() < 0.9}
    rows = [(x * 1000 + y, x, y, v) for (x, y), v in grid.items()] + [(99_001, 99, 1, None), (99_002, 99, 2, float("nan"))]
    cells = spark.createDataFrame(rows, "node long, x long, y long, v double")
    edges = T.cell_edges(cells, G.neighbours(cells, "node", []))
    forest = C.checkpointed(T.spanning_forest(edges))
    assert forest.count() <= len(grid) - 1
    steps = [float(t) for t in range(2, 22)]
    got = {}
    for r in T.components_at(cells, forest, steps).collect():
        got.setdefault(r["level"], {})[r["node"]] = r["component"]
    for i, t in enumerate(steps):
        root = {x * 1000 + y: x * 1000 + y for (x, y), v in grid.items() if v >= t}

        def find(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for (x, y), v in grid.items():
            for dx, dy in product((-1, 0, 1), repeat=2):
                if v >= t and grid.get((x + dx, y + dy), -1) >= t:
                    p, q = sorted((find(x * 1000 + y), find((x + dx) * 1000 + y + dy)))
                    root[q] = p
        assert got[i] == {k: find(k) for k in root}
    tree = {(r["level"], r["component"]): r for r in T.level_tree(cells, forest, steps).collect()}
    for (level, c), r in tree.items():
        mine = [k for k, v in got[level].items() if v == c]
        assert r["area"] == len(mine) and r["peak"] == max(grid[k // 1000, k % 1000] for k in mine) and r["threshold"] == steps[level]
        assert r["parent"] == (got[level - 1][c] if level else None)


def test_forest_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, w double")
    assert T.spanning_forest(none).collect() == []
    assert T.components_at(spark.createDataFrame([(1, 5.0)], "node long, v double"), none, [1.0, 9.0]).collect() == [(0, 1, 1)]
