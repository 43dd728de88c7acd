"""Energy of a tall matrix without gathering it: partial Gram matrices by task, added by Spark, k x k on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, column: str, width: int) -> DataFrame:
    """(i, j, g) with i <= j: the products of columns i and j over all rows, whose arrays have ``width`` entries.

    Rows with a null array or a null entry are left out; arrays of another length are an error."""
    kept = rows.select(F.col(column).cast("array<double>").alias("a")).where(F.col("a").isNotNull() & F.forall("a", lambda v: v.isNotNull()))
    checked = kept.select(F.when(F.size("a") == width, F.col("a")).otherwise(F.raise_error(F.lit(f"a row has not {width} entries")).cast("array<double>")).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column("a").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "g"])

    return checked.mapInArrow(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def energies(found: DataFrame, width: int) -> np.ndarray:
    """Squared singular values, the largest first, of a matrix with this Gram matrix (width x width numbers)."""
    g = np.zeros((width, width))
    for r in found.collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    return np.maximum(np.linalg.eigvalsh(g)[::-1], 0.0)


def rank_for(energy: np.ndarray, part: float, most: int | None = None) -> int:
    """How many components hold this part of all energy (at least one, at most ``most``); 0 of a matrix of zeros."""
    total = float(energy.sum())
    if not total:
        return 0
    k = int(np.searchsorted(np.cumsum(energy) / total, part - 1e-12) + 1)
    return min(k, len(energy) if most is None else most)
