"""Exact order statistics, and pairs and keys of cells, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrid.functions import scalars as S
from kinegrid.operators import components as C
from kinegrid.operators import grids as G
from kinegrid.operators import kernels as K
from kinegrid.operators import ranks as R


@pytest.mark.parametrize("few", [0, 50_000])
def test_order_statistics(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    rng = random.Random(1)
    values = [rng.choice([0.0, -1.5, 7.25, rng.gauss(0, 1), rng.gauss(0, 1) * 1e9, 1e-300 * rng.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    ranks = [0, 1, 17, 1500, 1501, 2998, 2999]
    assert R.order_statistics(df, "v", ranks) == [sorted(values)[r] for r in ranks]
    q = [0.0, 0.1, 0.5, 0.93, 1.0]
    assert R.quantiles(df, "v", q) == pytest.approx(list(np.quantile(values, q)))


def test_order_statistics_of_odd_columns(spark):
    assert R.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]
    assert R.quantiles(spark.createDataFrame([(3,)] * 9, "v int"), "v", [0.0, 0.5, 1.0]) == [3.0] * 3
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,), (0.0,)], "v double")
    assert R.order_statistics(wide, "v", [0, 1, 2]) == [-1.7e308, 0.0, 1.7e308]
    with pytest.raises(ValueError):
        R.order_statistics(wide, "v", [3])


def test_near_pairs(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(200)] + [(200, 0.0, 0.0), (201, 0.0, 0.0)]
    got = {(r["i"], r["j"]) for r in G.near_pairs(spark.createDataFrame(points, "n long, cx double, cy double"), "n", 1.3).collect()}
    assert got == {(i, j) for i, x, y in points for j, u, v in points if i < j and math.hypot(x - u, y - v) <= 1.3}


def test_components_on_a_wide_plane(spark):
    """Cells of a plane of 1500 x 630 and beyond: keys of different cells differ."""
    cells = [(0, 1000), (1, 0), (1, 1), (1499, 629), (1498, 628), (7, 5_000_000), (12, 0)]
    df = spark.createDataFrame(cells, "x long, y long").withColumn("node", G.cell_key("x", "y"))
    c = C.components(df.select("node"), G.neighbours(df, "node", []))
    got = sorted(r["n"] for r in c.groupBy("component").agg(F.count("*").alias("n")).collect())
    assert got == [1, 1, 1, 2, 2]


def test_best_correlations():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 8))
    a[4] = 2.0  # flat: correlates with nothing
    i, j, r = K.best_correlations(a, a, np.arange(30), np.arange(30), 3)
    whole = np.corrcoef(np.delete(a, 4, 0))
    assert 4 not in i and 4 not in j and len(i) == 87
    for k, row in enumerate(np.delete(np.arange(30), 4)):
        mine = np.sort(np.delete(whole[k], k))[::-1][:3]
        assert r[i == row] == pytest.approx(mine, abs=1e-8)


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_quantiles_of_groups(spark, buckets):
    """Every group against NumPy: ties, null keys and values, huge and denormal numbers, groups of one and of none."""
    rng = random.Random(1)
    some = lambda: rng.choice([rng.gauss(0, 1), float(rng.randrange(3)), 1e300 * rng.random(), None, float("nan"), -5e-324, 5e-324])
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i % 2, some()) for i in range(3000)] + [("one", 0, 7.5), ("none", 0, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, h int, v double, n int")
    at = {"least": 0, "low": 0.1, "median": 0.5, "high": 0.95, "most": 1}
    found = R.group_quantiles(df, ["g", "h"], "v", at, buckets)
    assert found.columns == ["g", "h", *at, "n"]
    got, want = {(r["g"], r["h"]): tuple(r)[2:] for r in found.collect()}, {}
    for g, h, v in rows:
        if v is not None and v == v:
            want.setdefault((g, h), []).append(v)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], [*np.quantile(v, list(at.values())), len(v)], rtol=1e-12)


def test_binomial_tail(spark):
    from fractions import Fraction
    from math import comb

    rows = [(k, n, p) for n in (0, 1, 5, 40) for k in range(n + 2) for p in (0.0, 0.01, 0.5, 0.97, 1.0)] + [(600, 1000, 0.5), (5, 1400, 0.5), (1399, 1400, 0.9)]
    df = spark.createDataFrame(rows, "k long, n long, p double")
    for r in df.select("*", S.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect():
        p = Fraction(r["p"])
        want = sum(comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"], r["n"] + 1))
        assert r["t"] == pytest.approx(float(want), abs=1e-9)
