"""Whitening of integer vectors by an exact residue-number scatter.

Entries become longs, x = floor(256 c). Of the distinct x vectors (the fit list: n of them, summing to S in each
dimension) the centred scatter C = sum (n x - S)(n x - S)' is an integer matrix, and C / n^3 is their covariance.

1. Sums: each partition adds the low and high halves of its entries in 64-bit numbers; Spark adds these as decimals.
2. Scatter: a partition takes n x - S modulo several primes just under 2^22 and multiplies each residue matrix with
   its own transpose in float64, which is exact for CHUNK rows of balanced residues. Its residues, one row for each
   prime and matrix row, are added by Spark, and Chinese remaindering of the sums gives the scatter without any rounding. The
   primes are as many as |C| <= n max|n x - S|^2 asks for, so no entry can wrap.
3. Model: C / n^3, each entry rounded once, goes through a double-precision eigh. What reaches the driver is d x d numbers a
   prime, whatever the number of rows.

Cases: rows whose vector is null, empty or has a null or non-finite entry are dropped, those with a null or repeated id
are kept, each row for itself. Equal vectors count once in the fit. Vectors of different lengths are different tables,
each with a fit of its own. Entries beyond the longs become the outermost long. With fewer dimensions than asked for
there are fewer components; one without variance (all of them for a single vector) has null ``whitened`` and
``explained`` 0 where the trace is 0, and stays out of ``identity_error``, which is 0 if none is left.
``deviation`` is null where it doesn't fit a long. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import gcd, isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SCALE, COMPONENTS = 256, 4
CHUNK = 2048  # rows of a product: 2048 * (2^21)^2 <= 2^53
NULL_SPACE = 1e-12  # of the trace: eigenvalues up to this are rounding
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def primes(least: int) -> list[int]:
    """Primes under 2^22, the largest first, whose product exceeds ``least``."""
    found, p = [], (1 << 22) - 1
    small = [k for k in range(3, 2048, 2) if all(k % q for q in range(3, isqrt(k) + 1, 2))]
    small = prod(small)
    while prod(found) <= least:
        if gcd(p, small) == 1:
            found.append(p)
        p -= 2
    return found


def remainder(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues (Garner's mixed radix)."""
    value, step = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += step * ((r - value) * pow(step, -1, p) % p)
        step *= p
    return value - step if value > step // 2 else value


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows with whole finite vectors, entries as longs."""
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = doubles.where((F.size("e") > 0) & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long")).alias("x"))


def totals(fit: DataFrame, d: int) -> tuple[int, np.ndarray, int]:
    """Rows of the fit list, their exact sums by dimension (integers) and the largest size of an entry."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, least, most, n = np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), d)
                low += (x & 0xFFFFFFFF).sum(0)
                high += (x >> 32).sum(0)
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(d), np.full(d, n), low, high, least, most)], names=["j", "n", "low", "high", "least", "most"])

    parts = fit.select("x").mapInArrow(halves, "j long, n long, low long, high long, least long, most long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    rows = parts.groupBy("j").agg(F.sum("n").alias("n"), exact("low").alias("low"), exact("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    sums, size = np.zeros(d, object), 0
    for r in rows:  # one for each dimension
        sums[r["j"]] = int(r["low"]) + (int(r["high"]) << 32)
        size = max(size, -r["least"], r["most"])
    return rows[0]["n"], sums, size


def scatter(fit: DataFrame, n: int, sums: np.ndarray, size: int) -> np.ndarray:
    """The exact sum of (n x - S)(n x - S)' over the fit list, as integers."""
    d = len(sums)
    farthest = n * size + max(map(abs, sums))
    moduli = primes(2 * n * farthest * farthest)
    shift = [(n % p, np.array([int(s) % p for s in sums], np.int64)) for p in moduli]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((d, d), np.int64) for _ in moduli]
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for lo in range(0, len(x), CHUNK):
                for at, (p, (k, s)) in enumerate(zip(moduli, shift, strict=True)):
                    y = (k * (x[lo : lo + CHUNK] % p) - s) % p
                    y = np.where(y > p // 2, y - p, y).astype(np.float64)
                    held[at] = (held[at] + (y.T @ y).astype(np.int64)) % p
        for p, found in zip(moduli, held, strict=True):
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, p)), pa.array(np.arange(d)), pa.array(found.tolist(), kind)], names=["p", "i", "row"])

    parts = fit.select("x").mapInArrow(products, "p long, i long, row array<long>")
    cells = parts.select("p", "i", F.posexplode("row").alias("j", "r")).where("j >= i")
    cells = cells.groupBy("i", "j", "p").agg(F.sum("r").alias("r"))
    out = np.zeros((d, d), object)
    found = {(r["i"], r["j"], r["p"]): r["r"] for r in cells.collect()}  # d (d + 1) / 2 cells a prime
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = remainder([found[i, j, p] % p for p in moduli], moduli)
    return out


class Model:
    """Centre and components of one fit list."""

    def __init__(self, n: int, sums: np.ndarray, scattered: np.ndarray, components: int = COMPONENTS):
        d = len(sums)
        self.n, self.sums = n, [int(s) for s in sums]
        self.covariance = np.array([[int(c) / n**3 for c in row] for row in scattered], float).reshape(d, d)
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        trace = float(np.trace(self.covariance))
        self.values = np.maximum(values[order], 0.0)
        self.vectors = vectors[:, order]
        self.some = self.values > NULL_SPACE * trace
        self.explained = self.values / trace if trace else np.zeros(len(order))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN for components without variance."""
        farthest = self.n * max(1, int(np.abs(x.astype(np.float64)).max(initial=0))) + max(map(abs, self.sums))
        kind = np.int64 if farthest < 1 << 62 else object
        centred = (x.astype(kind) * self.n - np.array(self.sums, kind)).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.some, centred @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2 by row, None beyond the longs."""
        farthest = self.n * max(1, int(np.abs(x.astype(np.float64)).max(initial=0))) + max(map(abs, self.sums))
        kind = np.int64 if len(self.sums) * farthest * farthest < 1 << 62 else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(1).tolist()]


def project(rows: DataFrame, model: Model) -> DataFrame:
    """A row for each row and component."""
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            each = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(model.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n, np.int64)),
                    deviation.take(pa.array(each)),
                    pa.array(model.whitened(x).ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, len(x))),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(run, RESULT)


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest entry, in size, of the fit list's whitened covariance minus the identity, measured on its rows."""
    keep = [i for i in range(len(model.values)) if model.some[i]]
    if not keep:
        return 0.0
    d, names = len(model.sums), [f"w{i}" for i in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.whitened(_matrix(batch.column("x"), d))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, i])) for i in keep], names=names)

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    whitened = fit.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    found = whitened.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(spark: SparkSession, vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, dict[int, Model]]:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) and the models by vector length."""
    scratch = Scratch(spark, "whitening")
    rows = scratch.write(integers(vectors, column), "rows")
    distinct = scratch.write(rows.select("x").distinct(), "fit")
    models, found = {}, []
    for d in sorted(r["d"] for r in distinct.select(F.size("x").alias("d")).distinct().collect()):
        fit = distinct.where(F.size("x") == d)
        n, sums, size = totals(fit, d)
        model = models[d] = Model(n, sums, scatter(fit, n, sums, size), components)
        some = project(rows.where(F.size("x") == d), model)
        found.append(some.withColumn("identity_error", F.lit(identity_error(fit, model))))
    none = spark.createDataFrame([], RESULT + ", identity_error double")
    return (reduce(DataFrame.unionByName, found) if found else none), models
