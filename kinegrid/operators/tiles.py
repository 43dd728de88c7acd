"""Stencils by tiles: a plane of any size is dealt into tiles with the borders of their neighbours, one Arrow call a tile.

A cell goes to its own tile and, where it lies within the stencil's reach of a seam, to the tiles beyond; what lies
beyond the plane is made of copies of its border cells, as the mode says, before the tiles are dealt. So a task
holds one tile and its halo, few cells are sent twice, and a result doesn't depend on the tiles' size. A neighbourhood of n
cells costs n multiplications a cell in NumPy in place of n copies of the cell in a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("constant", "replicate", "symmetric", "circular")


def _places(c: str, size: int, reach: int, mode: str) -> Column:
    """Where a cell stands for itself and for what lies beyond the plane, up to the reach, on one axis."""
    x = F.col(c).cast("long")
    own = F.array(x)
    none = F.array().cast("array<long>")
    if mode == "constant" or not reach:
        return own
    if mode == "replicate":
        low = F.when(x == 0, F.sequence(F.lit(-reach).cast("long"), F.lit(-1).cast("long"))).otherwise(none)
        high = F.when(x == size - 1, F.sequence(F.lit(size).cast("long"), F.lit(size + reach - 1).cast("long"))).otherwise(none)
    elif mode == "symmetric":
        low, high = F.when(x < reach, F.array(-1 - x)).otherwise(none), F.when(x >= size - reach, F.array(2 * size - 1 - x)).otherwise(none)
    else:
        low, high = F.when(x >= size - reach, F.array(x - size)).otherwise(none), F.when(x < reach, F.array(x + size)).otherwise(none)
    return F.concat(own, low, high)


def _tiles(c: Column, size: int, tile: int, reach: int) -> Column:
    """The tiles of one axis whose cells or halo hold a place."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((c - reach) / tile))
    last = F.least(F.lit((size - 1) // tile).cast("long"), F.floor((c + reach) / tile))
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<long>"))


def correlate(cells: DataFrame, keys: list[str], value: str, kernel: np.ndarray, width: int, height: int, mode: str = "constant", tile: int = 256) -> DataFrame:
    """(keys, x, y, value) of the plane's cells: sum over offsets (i, j) of kernel[i, j] times the cell at
    (x + i - rx, y + j - ry), (rx, ry) being the kernel's centre.

    Cells that are missing, null or NaN count as 0, and every cell of a tile that has any cell is returned where the input
    has it. Modes: 0 beyond the plane, its border cell, its mirror image, or its other end."""
    kernel = np.asarray(kernel, np.float64)
    if kernel.ndim != 2 or not all(n % 2 for n in kernel.shape) or mode not in MODES:
        raise ValueError(f"a kernel has odd sides, a mode is one of {', '.join(MODES)}")
    rx, ry = (n // 2 for n in kernel.shape)
    if rx > width or ry > height or tile < 1:
        raise ValueError("the kernel reaches beyond the plane's copies")
    v = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = cells.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).select(*keys, "x", "y", v.alias("_kg_v"))
    rows = rows.select(*keys, "_kg_v", "y", F.explode(_places("x", width, rx, mode)).alias("_kg_x"))
    rows = rows.select(*keys, "_kg_v", "_kg_x", F.explode(_places("y", height, ry, mode)).alias("_kg_y"))
    rows = rows.select("*", F.explode(_tiles(F.col("_kg_x"), width, tile, rx)).alias("_kg_tx"))
    rows = rows.select("*", F.explode(_tiles(F.col("_kg_y"), height, tile, ry)).alias("_kg_ty"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() for k in key[-2:])
        at = table.column("_kg_x").to_numpy() - tx * tile + rx, table.column("_kg_y").to_numpy() - ty * tile + ry
        a, here = np.zeros((tile + 2 * rx, tile + 2 * ry)), np.zeros((tile + 2 * rx, tile + 2 * ry), bool)
        a[at], here[at] = table.column("_kg_v").to_numpy(), True
        out = np.zeros((tile, tile))
        for i in range(kernel.shape[0]):
            for j in range(kernel.shape[1]):
                if kernel[i, j]:
                    out += kernel[i, j] * a[i : i + tile, j : j + tile]
        x, y = np.nonzero(here[rx : rx + tile, ry : ry + tile])  # the seams are the neighbours'
        gx, gy = x + tx * tile, y + ty * tile
        inside = (gx < width) & (gy < height)
        n = int(inside.sum())
        columns = {k: pa.array([v.as_py()] * n, t) for k, v, t in zip(keys, key, [table.schema.field(k).type for k in keys], strict=False)}
        return pa.table(columns | {"x": gx[inside], "y": gy[inside], value: out[x[inside], y[inside]]})

    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x long, y long", f"{value} double"])
    return rows.groupBy(*keys, "_kg_tx", "_kg_ty").applyInArrow(run, schema)
