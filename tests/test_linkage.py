"""Complete linkage in rounds against the one-by-one procedures, ties and a component of thousands included."""

import random

import numpy as np
import pytest

from kinegrid.operators import kernels as K
from kinegrid.operators import linkage as L


def labels(df):
    return {r["node"]: r["cluster"] for r in df.collect()}


def named(label):
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    return {i: first[x] for i, x in enumerate(label)}


@pytest.mark.parametrize("ties", [False, True])
def test_full_matrices(spark, ties):
    rng = np.random.default_rng(int(ties))
    d = rng.integers(1, 5, (24, 24)).astype(float) if ties else rng.random((24, 24)) * 4
    d = np.minimum(d, d.T)
    pairs = [(i, j, float(d[i, j])) for i in range(24) for j in range(i + 1, 24)]
    random.Random(3).shuffle(pairs)
    nodes = spark.createDataFrame([(i,) for i in range(24)], "node long")
    df = spark.createDataFrame([p if k % 2 else (p[1], p[0], p[2]) for k, p in enumerate(pairs)], "i long, j long, d double")
    for cut in (0.5, 1.0, 2.5, 9.0):
        assert labels(L.complete_linkage(nodes, df, cut)) == named(K.linkage_labels(d, cut))


def test_five_thousand_nodes_of_one_component(spark):
    """Points of a square with the distances below a reach: one component, clustered as the heap does."""
    rng = np.random.default_rng(2)
    n, reach = 5000, 0.032
    p = rng.random((n, 2))
    buckets = {}
    for i, (x, y) in enumerate(p):
        buckets.setdefault((int(x / reach), int(y / reach)), []).append(i)
    edges = []
    for (bx, by), mine in buckets.items():
        near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in buckets.get((bx + dx, by + dy), ())]
        for i in mine:
            edges += [(float(np.hypot(*(p[i] - p[j]))), i, j) for j in near if i < j]
    edges = [e for e in edges if e[0] <= reach]
    root = list(range(n))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for _, i, j in edges:
        root[find(i)] = find(j)
    sizes = np.bincount([find(i) for i in range(n)])
    assert sizes.max() > 4900
    found = labels(L.complete_linkage(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame([(i, j, d) for d, i, j in edges], "i long, j long, d double"), reach))
    assert found == named(K.sparse_linkage(n, edges, reach)) and len(set(found.values())) < n / 3


def test_cases(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,), (9,)], "node long")
    rows = [(1, 2, 0.1), (2, 1, 0.4), (2, 3, None), (3, 3, 0.0), (None, 1, 0.1), (1, 3, float("nan"))]
    df = spark.createDataFrame(rows, "i long, j long, d double")
    assert labels(L.complete_linkage(nodes, df, 0.2)) == {1: 1, 2: 2, 3: 3, 9: 9}  # of a pair given twice the larger distance
    assert labels(L.complete_linkage(nodes, df, 0.4)) == {1: 1, 2: 1, 3: 3, 9: 9}
    assert L.complete_linkage(nodes.limit(0), df.limit(0), 1.0).collect() == []
