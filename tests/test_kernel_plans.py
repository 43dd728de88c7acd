"""Queries without SQL against NumPy on arrays that DuckDB reads from the same tables."""

import itertools
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from kinegrid.operators import kernels as K
from kinegrid.operators import modes as M
from kinegrid.operators import registration as R
from kinegrid.operators import structure as S
from kinegrid.plans import inputs as I
from kinegrid.plans import registry
from kinegrid.plans.join_plans import ACTIVE
from kinegrid.plans.window_plans import UNITS

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return lambda q: con.execute(q).fetchall()


@pytest.fixture(scope="module")
def field(sql):
    """(t, x, y) to (dx, dy, n)."""
    return {(t, x, y): (dx, dy, n) for t, x, y, dx, dy, n in sql(f"WITH {I.FIELD} SELECT * FROM field")}


@pytest.fixture(scope="module")
def volumes(sql):
    out = {}
    for t, x, y, z, v in sql(f"WITH {I.VOLUME} SELECT t, x, y, z, v FROM volume"):
        out.setdefault(t, {})[x, y, z] = v
    return out


def boxed(cells, r=1):
    """Means over squares with repeated borders, element by element."""
    a = np.full((40, 25), 25.0)
    for p, v in cells.items():
        a[p] = v
    out = np.empty_like(a)
    for i, j in itertools.product(range(40), range(25)):
        out[i, j] = np.mean([a[min(max(i + k, 0), 39), min(max(j + m, 0), 24)] for k in range(-r, r + 1) for m in range(-r, r + 1)])
    return out


def monthly(field):
    """Of each month its cells and its year's mean over the months that have the cell."""
    year = defaultdict(lambda: defaultdict(list))
    for (t, x, y), v in field.items():
        year[t // 12][x, y].append(v[0])
    for t in sorted({t for t, _, _ in field}):
        own = {(x, y): v[0] for (u, x, y), v in field.items() if u == t}
        yield t, own, {p: float(np.mean(year[t // 12][p])) for p in own}


def test_registered_frames_and_structure(spark, sf_dir, field):
    got = {r["t"]: r for r in QUERIES["registered_frames"](spark, sf_dir).collect()}
    shape = {r["t"]: r for r in QUERIES["frame_structure"](spark, sf_dir).collect()}
    months = list(monthly(field))
    assert got.keys() == shape.keys() == {t for t, _, _ in months}
    for t, own, ref in months[::12]:
        a, b = boxed(own), boxed(ref)
        m = R.flow(a, b, layers=2, radius=3)
        assert got[t]["error_before"] == pytest.approx(((b - a) ** 2).mean(), abs=1e-5)
        assert got[t]["error_after"] == pytest.approx(((b - R.warp(a, m.field)) ** 2).mean(), abs=1e-5)
        assert got[t]["mean_dx"] == pytest.approx(m.field[0].mean(), abs=1e-5)
        assert shape[t]["mind"] == pytest.approx(S.mind_difference(a, b).mean(), abs=1e-5) and shape[t]["zscore"] == pytest.approx(S.zscore_difference(a, b).mean(), abs=1e-5)
        assert shape[t]["edges"] == pytest.approx(S.edge_distance(a, b), abs=1e-5)
    assert all(r["error_after"] <= r["error_before"] for r in got.values())


def test_volumes_and_slices(spark, sf_dir, volumes):
    mean = defaultdict(list)
    for v in volumes.values():
        for p, x in v.items():
            mean[p].append(x)
    whole = {r["t"]: r for r in QUERIES["volume_motion"](spark, sf_dir).collect()}
    slices = {r["t"]: r for r in QUERIES["slice_motion"](spark, sf_dir).collect()}
    grown = {r["t"]: tuple(r)[1:] for r in QUERIES["grown_regions"](spark, sf_dir).collect()}
    assert whole.keys() == slices.keys() == grown.keys() == volumes.keys()
    for t, v in volumes.items():
        a, b, raw = np.full((40, 25, 7), 25.0), np.full((40, 25, 7), 25.0), np.full((40, 25, 7), 25.0)
        for p, x in v.items():
            a[p], b[p], raw[p] = x, np.mean(mean[p]), x
        a, b = (np.stack([boxed({(i, j): q[i, j, k] for i in range(40) for j in range(25)}) for k in range(7)], 2) for q in (a, b))
        assert whole[t]["error_before"] == pytest.approx(((a - b) ** 2).mean(), abs=1e-5) and whole[t]["error_after"] <= whole[t]["error_before"]
        assert slices[t]["error_before"] == pytest.approx(((a[:, :, 1::2] - b[:, :, 1:6:2]) ** 2).mean(), abs=1e-5) and slices[t]["error_after"] <= slices[t]["error_before"]
        seed = raw > 45
        assert grown[t][0] == int(seed.sum()) and grown[t][1] == int(S.grow(seed, raw > 25, S.ball(1, 2.0), 2).sum()) and grown[t][2] <= grown[t][1]


def test_recordings(spark, sf_dir, field):
    got = defaultdict(dict)
    for r in QUERIES["recording_motion"](spark, sf_dir).collect():
        got[r["channel"]][r["t"]] = r
    months = sorted({t for t, _, _ in field})
    assert got.keys() == {"first", "second"} and all(sorted(v) == months for v in got.values())
    frames = []
    for t in months:
        a = np.full((40, 25), 25.0)
        for (u, x, y), v in field.items():
            if u == t:
                a[x, y] = v[0]
        frames.append(R.mean_box(a, (1, 1)))
    for t, (m, _, _) in zip(months, R.register_recording(frames, layers=2, radius=3, rounds=5), strict=True):
        assert got["first"][t]["error_before"] == pytest.approx(m.before, rel=0.05, abs=1e-3) and m.after <= m.before
    assert all(r["error_after"] <= r["error_before"] for v in got.values() for r in v.values())


def test_reliability_and_spots(spark, sf_dir, field):
    years = defaultdict(lambda: defaultdict(list))
    for (t, x, y), v in field.items():
        years[t // 12][x, y].append(v[0])
    image = {k: {p: float(np.mean(x)) for p, x in v.items()} for k, v in years.items()}
    got = {r["year"]: r for r in QUERIES["reference_reliability"](spark, sf_dir).collect()}
    assert got.keys() == {k for k in image if k + 1 in image}
    for k, r in got.items():
        both = image[k].keys() & image[k + 1].keys()
        a, b = (boxed({p: image[q][p] for p in both}) for q in (k, k + 1))
        assert r["difference_before"] == pytest.approx(S.mind_difference(a, b).mean(), abs=1e-5)
        mask, apart, _ = S.difference_mask(a, R.warp(b, R.flow(b, a, layers=2, radius=3).field))
        assert r["masked"] == int((~mask).sum()) and r["difference_after"] == pytest.approx(apart.mean(), abs=1e-5)
    for r in QUERIES["significant_spots"](spark, sf_dir).collect():
        a = np.full((40, 25), 25.0)
        for p, v in image[r["year"]].items():
            a[p] = v
        z = S.significance(a, np.quantile(a, [0.7, 0.8, 0.9, 0.95]), least=4, most=200)
        assert (r["peak"], r["cells"]) == (pytest.approx(z.max(), abs=1e-5), int((z > 0).sum()))


@pytest.fixture(scope="module")
def bands(field):
    """The block means of each band as (t, n, 2) around their mean, and the blocks' places."""
    sums = defaultdict(list)
    for (t, x, y), (dx, dy, _) in field.items():
        sums[t, x // 5, y // 5].append((dx, dy))
    out, months = {}, sorted({t for t, _, _ in field})
    for band in sorted({k[2] for k in sums}):
        blocks = {k: np.mean(v, axis=0) for k, v in sums.items() if k[2] == band}
        mean, columns = np.mean(list(blocks.values()), axis=0), sorted({k[1] for k in blocks})
        y = np.zeros((len(months), len(columns), 2))
        for (t, x, _), v in blocks.items():
            y[months.index(t), columns.index(x)] = v - mean
        out[band] = y, np.array([[float(x), float(band)] for x in columns])
    return out


def test_field_modes_and_ranks(spark, sf_dir, bands):
    got = defaultdict(dict)
    for r in QUERIES["field_modes"](spark, sf_dir).collect():
        got[r["band"]][r["mode"]] = r
    ranks = {r["band"]: r for r in QUERIES["energy_ranks"](spark, sf_dir).collect()}
    assert got.keys() == ranks.keys() == bands.keys()
    for band, (y, coords) in bands.items():
        m = M.fit_modes(y, coords)
        assert len(got[band]) == len(m.h)
        flat = y.reshape(len(y), -1)
        left = flat - sum(np.outer(m.h[k], m.b[k].ravel()) for k in range(len(m.h)))
        assert got[band][0]["explained"] == pytest.approx(1 - (left**2).sum() / (flat**2).sum(), abs=1e-4)
        assert [got[band][k]["support"] for k in range(len(m.h))] == m.support.sum(1).tolist()
        s = np.linalg.eigvalsh(flat @ flat.T)[::-1]
        share = np.cumsum(s) / s.sum()
        assert ranks[band]["shares"] == pytest.approx(share[:4].tolist(), abs=1e-5)
        assert ranks[band]["rank"] == min(4, int(np.argmax(share >= 0.85)) + 1)


def slow_dtw(x, y):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(1, len(x) + 1), range(1, len(y) + 1)):
        d[i, j] = abs(x[i - 1] - y[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1] / (len(x) + len(y))


@pytest.fixture(scope="module")
def regions(sql):
    cells, traces = defaultdict(set), defaultdict(list)
    for i, x, y in sql(f"WITH {I.PATCHES}, {ACTIVE} SELECT * FROM act"):
        cells[i].add((x, y))
    for i, v in sql(f"WITH {I.PATCHES} SELECT site, v FROM patches ORDER BY site, t"):
        traces[i].append(v)
    return cells, {k: np.array(v) for k, v in traces.items()}


def gated(cells):
    centre = {k: np.mean(list(v), axis=0) for k, v in cells.items()}
    for i, j in itertools.combinations(sorted(cells), 2):
        if i % 3 != j % 3:
            iou = len(cells[i] & cells[j]) / len(cells[i] | cells[j])
            if iou >= 0.3 or math.dist(centre[i], centre[j]) <= 1:
                yield i, j, iou


def test_region_distances_patterns_and_modes(spark, sf_dir, sql, regions):
    cells, traces = regions
    h = {k: v / max(v.max(), 1.0) for k, v in traces.items()}
    want = {}
    for i, j, iou in gated(cells):
        plus, minus = slow_dtw(h[i], h[j]), slow_dtw(h[i], -h[j])
        want[i, j] = (round(iou, 6), round(min(plus, minus), 9), -1 if minus < plus else 1)
    got = {(r["i"], r["j"]): (r["iou"], r["distance"], r["sign"]) for r in QUERIES["region_distances"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)

    ids = sorted(cells)
    d = np.full((len(ids), len(ids)), 1e6)
    for (i, j), (_, x, _) in want.items():
        a, b = ids.index(i), ids.index(j)
        d[a, b] = d[b, a] = x
    label = K.linkage_labels(d, 0.2)
    first = {k: ids[int(np.argmax(label == k))] for k in set(label.tolist())}
    patterns = {r["region"]: r["pattern"] for r in QUERIES["region_patterns"](spark, sf_dir).collect()}
    assert patterns == {i: first[k] for i, k in zip(ids, label.tolist(), strict=True)}

    members = defaultdict(list)
    for i in ids:
        members[patterns[i]].append(i)
    modes = {r["pattern"]: r for r in QUERIES["pattern_modes"](spark, sf_dir).collect()}
    assert modes.keys() == members.keys()
    for p, own in members.items():
        mean, signs, best = K.unified_trace([traces[i] for i in own], np.array([max(traces[i].sum(), 1.0) for i in own]))
        assert (modes[p]["members"], modes[p]["medoid"], modes[p]["flipped"]) == (len(own), own[best], int((signs < 0).sum()))
        assert modes[p]["activation"] == pytest.approx(mean.tolist(), abs=1e-5)

    units = defaultdict(set)
    for site, t0, t1 in sql(f"WITH {I.PATCHES}, {UNITS} SELECT site, t0, t1 FROM units"):
        units[site].add((t0, t1))
    found = {r["pattern"]: r for r in QUERIES["pattern_summaries"](spark, sf_dir).collect()}
    assert found.keys() == {p for p, own in members.items() if len(own) > 1}
    for p, r in found.items():
        weight = defaultdict(float)
        for i in members[p]:
            for x, y in cells[i]:
                weight[x, y] += traces[i][x]
        w, at = np.array(list(weight.values())), np.array(list(weight), float)
        c = (w[:, None] * at).sum(0) / w.sum()
        v = (w[:, None] * (at - c) ** 2).sum(0) / w.sum()
        assert r["regions"] == members[p] and r["episodes"] == len(set().union(*(units[i] for i in members[p])))
        assert (r["strength"], r["area_eff"], r["cx"], r["cy"], r["vxx"], r["vyy"]) == pytest.approx((w.sum(), w.sum() ** 2 / (w**2).sum(), *c, *v), rel=1e-5, abs=1e-4)


def test_mode_regions(spark, sf_dir, field):
    want = []
    for t in sorted({t for t, _, _ in field}):
        own = {(x, y): v for (u, x, y), v in field.items() if u == t}
        a = np.zeros((46, 31))
        for (x, y), (_, dy, n) in own.items():
            a[x + 3, y + 3] = dy * n
        support = a > 0.5 * a.max()
        square = np.ones((3, 3), bool)
        closed = ~S.dilate(~S.dilate(support, square), square) | support
        numbers, n = S.label(S.dilate(closed, square))
        for k in range(1, n + 1):
            mine = support & (numbers == k)
            if mine.sum() >= 4:
                x, y = np.nonzero(mine)
                w = a[mine]
                want.append((t, int(mine.sum()), w.sum(), (w * (x - 3)).sum() / w.sum(), (w * (y - 3)).sum() / w.sum(), sum(q * own[i - 3, j - 3][0] for i, j, q in zip(x, y, w, strict=True)) / w.sum()))
    got = sorted((r["t"], r["area"], r["strength"], r["cx"], r["cy"], r["mean_dx"]) for r in QUERIES["mode_regions"](spark, sf_dir).collect())
    assert len(got) == len(want) and all(g == pytest.approx(w, rel=1e-4, abs=2e-4) for g, w in zip(got, sorted(want), strict=True))


def test_simulated_recovery(spark, sf_dir):
    rows = QUERIES["simulated_recovery"](spark, sf_dir).collect()
    assert len(rows) == 24 and all(r["error_after"] <= r["error_before"] for r in rows)
    calm = [r for r in rows if not r["noise"]]
    assert np.mean([r["error_after"] / r["error_before"] for r in calm]) < 0.5


def test_largest_regions_and_discs(spark, sf_dir):
    best = {}
    for r in QUERIES["mode_regions"](spark, sf_dir).collect():
        if r["t"] not in best or (r["area"], r["strength"]) > best[r["t"]]:
            best[r["t"]] = (r["area"], r["strength"])
    assert {r["t"]: (r["area"], r["strength"]) for r in QUERIES["largest_regions"](spark, sf_dir).collect()} == best
    frames = defaultdict(dict)
    for r in QUERIES["simulated_cells"](spark, sf_dir).collect():
        frames[r["t"]][r["x"], r["y"]] = r["v"]
    assert frames.keys() == {1, 2, 3, 4, 5}
    for t, own in frames.items():
        a = K.moving_discs((48, 32), 6, t, 1)
        assert own == {(int(x), int(y)): pytest.approx(a[x, y], abs=1e-6) for x, y in np.argwhere(a)}


def test_reconstructed_field(spark, sf_dir, bands):
    rest = defaultdict(float)
    for r in QUERIES["reconstructed_field"](spark, sf_dir).collect():
        rest[r["band"]] += r["rest"] ** 2
    explained = {r["band"]: r["explained"] for r in QUERIES["field_modes"](spark, sf_dir).collect()}
    for band, (y, _) in bands.items():
        assert 1 - rest[band] / (y**2).sum() == pytest.approx(explained[band], abs=1e-4)


def test_quality_frames(spark, sf_dir, field):
    rows = QUERIES["quality_frames"](spark, sf_dir).collect()
    months = sorted({t for t, _, _ in field})
    assert sorted((r["channel"], r["t"]) for r in rows) == [(c, t) for c in ("first", "second") for t in months]
    assert all(r["error_after"] <= r["error_before"] and 0 <= r["masked"] <= 1 for r in rows)
    frames = []
    for t in months[:6]:
        frames.append(boxed({(x, y): v[0] for (u, x, y), v in field.items() if u == t}))
    first = next(r for r in rows if r["channel"] == "first" and r["t"] == months[0])
    assert first["error_before"] == pytest.approx(((np.mean(frames, axis=0) - frames[0]) ** 2).mean(), abs=1e-5)
