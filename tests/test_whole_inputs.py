"""Queries over all parts and all sites against brute force on the smallest tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinegrid.operators import kernels as K
from kinegrid.plans import inputs as I
from kinegrid.plans import registry
from kinegrid.plans.join_plans import active_cells
from kinegrid.plans.window_plans import units

QUERIES = registry.queries()


def test_reference_intervals_of_all_parts(spark, sf_dir):
    parts = [(r["p_partkey"], r["p_size"]) for r in I.table(spark, sf_dir, "part").collect()]
    last = max(k for k, _ in parts)
    want = Counter()
    for r in I.table(spark, sf_dir, "orders").select("o_orderkey").collect():
        frame = r["o_orderkey"] % last
        want.update((r["o_orderkey"], frame, f"vol_ref_{a:06d}_{a + n:06d}.tif") for a, n in parts if a <= frame <= a + n)
    assert Counter(tuple(r) for r in QUERIES["reference_intervals"](spark, sf_dir).collect()) == want


@pytest.fixture(scope="module")
def starts(spark, sf_dir):
    """Onsets by region: days on which an interval of a site of the grid's row begins and none is open."""
    out = {}
    rows = units(spark, sf_dir).collect()
    for roi in {r["site"] // 15 for r in rows}:
        days = {t for r in rows if r["site"] // 15 == roi for t in range(r["t0"], r["t1"] + 1)}
        out[roi] = sorted(t for t in days if t - 1 not in days)
    return out


@pytest.fixture(scope="module")
def clicks(spark, sf_dir):
    out = defaultdict(dict)
    for r in I.patches(spark, sf_dir, "click").collect():
        out[r["site"]][r["t"]] = r["v"] > 0
    return {site: [a[t] for t in range(len(a))] for site, a in out.items()}


def test_event_hit_rates_of_all_sites(spark, sf_dir, starts, clicks):
    want = {}
    for site, a in clicks.items():
        own = starts.get(site // 15, [])
        if own:
            hits = sum(any(a[s : s + 4]) for s in own)
            want[site] = (len(own), hits, round(hits / len(own), 6))
    got = {r["site"]: (r["windows"], r["hits"], r["rate"]) for r in QUERIES["event_hit_rates"](spark, sf_dir).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


@pytest.mark.parametrize(("name", "lags"), [("lag_coupling", range(6)), ("lags_around", range(-4, 5))])
def test_lag_coupling_of_all_sites(spark, sf_dir, starts, clicks, name, lags):
    got = {r["site"]: tuple(r)[1:] for r in QUERIES[name](spark, sf_dir).collect()}
    probabilities = {}
    for site, a in clicks.items():
        base = [any(a[t : t + 3]) for t in range(len(a) - 2)]
        probabilities[site] = sum(base) / len(base)
        best = None
        for lag in lags:
            spans = [a[s + lag : s + lag + 3] for s in starts.get(site // 15, []) if 0 <= s + lag < len(a)]
            if spans:
                d = round(sum(map(any, spans)) / len(spans) - probabilities[site], 6)
                if best is None or d > best[3] + 1e-9:
                    best = (lag, len(spans), sum(map(any, spans)), d)
        assert (site in got) == (best is not None) and (best is None or got[site] == pytest.approx(best, abs=2e-6))
    if name == "lag_coupling":
        for r in QUERIES["coupling_pvalues"](spark, sf_dir).collect():
            assert tuple(r)[1:5] == got[r["site"]]
            assert r["p_value"] == pytest.approx(K.binomial_tail(r["hits"], r["windows"], probabilities[r["site"]]), abs=2e-6)


def test_pairs_near_by_centroid_alone(spark, sf_dir):
    """All pairs of all regions, by the definition."""
    cells = defaultdict(set)
    for r in active_cells(spark, sf_dir).collect():
        cells[r["region"]].add((r["x"], r["y"]))
    centre = {k: (sum(x for x, _ in v) / len(v), sum(y for _, y in v) / len(v)) for k, v in cells.items()}
    want = {}
    for i in cells:
        for j in cells:
            if i < j and i % 3 != j % 3:
                both, d = len(cells[i] & cells[j]), math.dist(centre[i], centre[j])
                iou = both / len(cells[i] | cells[j])
                if both or d <= 1:
                    want[i, j] = (round(iou, 6), round(d, 6), "iou" if iou >= 0.3 else "centroid" if d <= 1 else "none")
    got = {(r["i"], r["j"]): (r["iou"], r["distance"], r["reason"]) for r in QUERIES["compatible_regions"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and any(not v[0] for v in want.values())
    assert all(got[k][2] == want[k][2] and got[k][:2] == pytest.approx(want[k][:2], abs=2e-6) for k in want)


def test_rest_volume_against_the_kernel(spark, sf_dir):
    rows = I.patches(spark, sf_dir).collect()
    a = np.zeros((rows[0]["frames"], 15, max(r["y"] for r in rows) + 1))
    for r in rows:
        a[r["t"], r["x"], r["y"]] = r["v"]
    want = K.rest_state(a, 5, 3, 2.0, 21)
    got = QUERIES["rest_volume"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["rest"] == pytest.approx(want[r["t"], r["site"] % 15, r["site"] // 15], abs=2e-6)
