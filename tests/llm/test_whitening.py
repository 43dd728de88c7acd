from fractions import Fraction

import numpy as np
import pytest

from kinegrid.llm import queries as Q
from kinegrid.llm import whitening as W


def brute(rows, k=4):
    """n, deviations, covariance and eigenpairs by exact fractions of the distinct vectors."""
    good = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    fit = sorted({x for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[Fraction(n * x[j] - s[j], n) for j in range(d)] for x in fit]
    cov = np.array([[float(sum(y[i] * y[j] for y in centred) / n) for j in range(d)] for i in range(d)])
    return good, n, s, cov


def check(found, rows, k=4):
    good, n, s, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, len(s))
    assert len(found) == k * len(good)
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, x in good:
        y = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s, strict=True)])
        for c in range(k):
            r = by[i, c + 1][0]
            assert r["n"] == n and r["deviation"] == sum((n * a - t) ** 2 for a, t in zip(x, s, strict=True))
            assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(y @ vectors[:, c]) / np.sqrt(values[c]), abs=1e-8)
            assert r["identity_error"] <= 1e-9


def test_registered_query(spark, sf_dir):
    found = Q.queries()["op11_embedding_whitening"](spark, sf_dir).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(found, rows)
    signs = {}
    good, n, s, cov = brute(rows)
    vectors = np.linalg.eigh(cov)[1][:, ::-1]
    for r in found:
        x = dict(good)[r["vec_id"]]
        value = (np.array(x) - np.array(s) / n) @ vectors[:, r["component"] - 1]
        if abs(r["whitened"]) > 1e-3:
            signs.setdefault(r["component"], set()).add(np.sign(value) * np.sign(r["whitened"]))
    assert all(len(v) == 1 for v in signs.values())


def test_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 5)) * [8, 4, 2, 1, 0.5] - 3)]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("-inf")] * 5), (104, []), (105, rows[7][1]), (None, rows[8][1])]
    df = spark.createDataFrame([(*r, 1.0, "p") for r in rows], "vec_id long, embedding array<double>, x double, p string")
    check(W.whiten(spark, df)[0].collect(), rows)


def test_lengths_are_fits_of_their_own(spark):
    rows = [(1, [1.0]), (2, [2.0]), (3, [1.0, 5.0]), (4, [2.0, 7.0]), (5, [0.0, 1.5]), (6, [9.0, 9.0, 9.0])]
    found = W.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0].collect()
    check([r for r in found if r["vec_id"] < 3], rows[:2])
    check([r for r in found if 3 <= r["vec_id"] < 6], rows[2:5])
    alone = [r for r in found if r["vec_id"] == 6]  # one vector has no variance
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(c, 1, 0, None, 0.0, 0.0) for c in (1, 2, 3)]


def test_empty(spark):
    found, models = W.whiten(spark, spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert found.collect() == [] and models == {}
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_where_doubles_are_not(spark):
    """Entries near 2^60: the scatter has over 130 bits, sums exceed a long, deviations don't fit one."""
    rows = [(i, [2.0**52 + i, -(2.0**50) * (i + 1), 3.0 * i]) for i in range(40)] + [(99, [1e30, -1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [tuple(r["x"]) for r in W.integers(df).collect()]
    assert ints[-1] == (2**63 - 1, -(2**63), 0)
    fit = W.integers(df).select("x")
    n, sums, size = W.totals(fit, 3)
    assert (n, list(sums), size) == (41, [sum(x[j] for x in ints) for j in range(3)], 2**63)
    got = W.scatter(fit, n, sums, size)
    want = [[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in ints) for j in range(3)] for i in range(3)]
    assert got.tolist() == want
    assert all(r["deviation"] is None for r in W.whiten(spark, df)[0].collect())


def test_remaindering():
    moduli = W.primes(1 << 80)
    assert all(p < 1 << 22 and all(p % q for q in range(2, 2049)) for p in moduli) and len(set(moduli)) == len(moduli)
    for v in (0, 1, -1, 2**79, -(2**79), 123456789**2):
        assert W.remainder([v % p for p in moduli], moduli) == v
