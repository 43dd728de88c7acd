"""Column functions: intensity transforms, clamps, determinants, windows of weights, safe arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def transform(x: Column, k: float = 1.0, method: str = "raw") -> Column:
    """k * x, or k times its square root, log2(1 + x) or log10(1 + x)."""
    of = {"raw": x, "sqrt": F.sqrt(x), "log2": F.log2(1 + x), "log10": F.log10(1 + x)}
    if method not in of:
        raise ValueError(f"method must be one of {sorted(of)}")
    return F.lit(k) * of[method]


def fuse(mem: Column, ca: Column, k: float = 1.0, method: str = "raw") -> Column:
    """The first channel plus the transformed second where there is one."""
    return F.coalesce(mem + transform(ca, k, method), mem)


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi)


def stretch(x: Column, lo: Column, hi: Column, top: float = 1.0, eps: float = 1e-8) -> Column:
    """Clip to [lo, hi] and rescale to [0, top]."""
    return (clamp(x, lo, hi) - lo) / (hi - lo + eps) * top


def subscripts(index: Column, rows: int, columns: int) -> tuple[Column, Column, Column]:
    """Row, column and plane of a linear row-major index."""
    return F.pmod(F.floor(index / columns), F.lit(rows)), F.pmod(index, F.lit(columns)), F.floor(index / (rows * columns))


def det2(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a * d - b * c


def det3_symmetric(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def hann(i: Column, n: int) -> Column:
    """One factor of a separable Hann window over 0..n-1."""
    return 0.5 * (1 - F.cos(i * (2 * math.pi / (n - 1))))


def safe_double(x: Column, default: float = 0.0) -> Column:
    """The number in a text, or the default where there is none or it is not finite."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def in_disc(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius


def in_box(x: Column, y: Column, x0: int, y0: int, x1: int, y1: int) -> Column:
    """Half-open box."""
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def r6(x: Column) -> Column:
    """Six decimals, with no negative zero: sums of doubles depend on their order beyond that."""
    return F.round(x, 6) + F.lit(0.0)


def between(lo: Column, hi: Column, d: Column) -> Column:
    """lo * (1 - d) + hi * d as a fused multiply-add rounds it (the product with lo isn't rounded by itself), as quantiles are
    interpolated in SQL: a value next to lo or hi is then on the same side of the quantile in both."""
    w, c = 1 - d, hi * d
    high = lambda x: F.lit(134217729.0) * x - (F.lit(134217729.0) * x - x)  # noqa: E731 the upper half of the digits
    p, a, b = lo * w, high(lo), high(w)
    rest = ((a * b - p) + a * (w - b) + (lo - a) * b) + (lo - a) * (w - b)
    total = p + c
    out = total + ((p - (total - (total - p))) + (c - (total - p)) + rest)
    return F.when(F.isnan(out), total).otherwise(out)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """Probability of k or more hits in n tries at the rate p: one pass over the terms, each from the one before by its
    ratio, in logs, so n steps and no underflow however far the tail begins from the mode."""
    k, n, p = k.cast("long"), n.cast("long"), p.cast("double")
    zero = F.lit(0.0)
    choose = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), zero, lambda a, j: a + F.log((n - k + j) / j))
    start = F.struct((choose + k * F.log(p) + (n - k) * F.log1p(-p)).alias("log"), zero.alias("total"))
    odds = F.log(p) - F.log1p(-p)
    step = lambda a, i: F.struct((a["log"] + F.log(F.greatest(n - i, F.lit(1)) / (i + 1)) + odds).alias("log"), (a["total"] + F.exp(a["log"])).alias("total"))
    tail = F.aggregate(F.sequence(k, F.greatest(n, k)), start, step, lambda a: F.least(F.lit(1.0), a["total"]))
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(tail)
