"""Stencils by tiles against NumPy's padding, equal across sizes of tiles and modes of borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrid.operators import tiles as T

PADS = {"constant": {}, "replicate": {"mode": "edge"}, "symmetric": {"mode": "symmetric"}, "circular": {"mode": "wrap"}}


def slow(a, kernel, mode):
    rx, ry = (n // 2 for n in kernel.shape)
    p = np.pad(a, ((rx, rx), (ry, ry)), **PADS[mode])
    return sum(kernel[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(kernel.shape[0]) for j in range(kernel.shape[1]))


@pytest.mark.parametrize("mode", T.MODES)
@pytest.mark.parametrize(("tile", "shape"), [(4, (3, 5)), (7, (1, 3)), (100, (5, 3)), (2, (5, 5))])
def test_against_padding(spark, mode, tile, shape):
    rng = np.random.default_rng(tile)
    planes, kernel = rng.normal(size=(2, 17, 11)), rng.normal(size=shape)
    rows = [(t, x, y, float(planes[t, x, y]), 3) for t in range(2) for x in range(17) for y in range(11)]
    df = spark.createDataFrame([*rows, (0, 40, 2, 9.0, 3), (1, -1, 2, 9.0, 3)], "t int, x long, y int, v double, tx int")
    got = {(r["t"], r["x"], r["y"]): r["v"] for r in T.correlate(df, ["t"], "v", kernel, 17, 11, mode, tile).collect()}
    assert len(got) == 2 * 17 * 11
    for t in range(2):
        want = slow(planes[t], kernel, mode)
        assert all(got[t, x, y] == pytest.approx(want[x, y]) for x in range(17) for y in range(11))


def test_a_plane_of_a_real_frame(spark):
    """1,500 x 630 cells made by Spark, whole numbers: equal to the last digit whatever the tiles."""
    i = F.col("id")
    cells = spark.range(1500 * 630, numPartitions=6).select((i / 630).cast("long").alias("x"), (i % 630).alias("y"), (i * 7919 % 251).cast("double").alias("v"))
    kernel = np.arange(21).reshape(3, 7) - 4.0
    plane = (np.arange(1500 * 630) * 7919 % 251).reshape(1500, 630).astype(float)
    want = slow(plane, kernel, "replicate")
    weight = (F.col("x") * 31 + F.col("y") * 17) % 1009
    for tile in (128, 512):
        out = T.correlate(cells, [], "v", kernel, 1500, 630, "replicate", tile)
        n, total, mixed = out.agg(F.count("*"), F.sum("v"), F.sum(weight * F.col("v"))).first()
        x, y = np.indices(plane.shape)
        assert (n, total, mixed) == (plane.size, want.sum(), ((x * 31 + y * 17) % 1009 * want).sum())


def test_missing_cells_and_errors(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (2, 2, None), (1, 1, float("nan"))], "x long, y long, v double")
    got = {(r["x"], r["y"]): r["v"] for r in T.correlate(df, [], "v", np.ones((3, 3)), 4, 4).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 0.0}
    assert T.correlate(df.limit(0), [], "v", np.ones((3, 3)), 4, 4).collect() == []
    for bad in ({"kernel": np.ones((2, 3))}, {"mode": "edge"}, {"kernel": np.ones((11, 1))}):
        with pytest.raises(ValueError):
            T.correlate(df, [], "v", **({"kernel": np.ones((3, 3)), "width": 4, "height": 4} | bad))
