"""Flow, cross-resolution flow and recordings on planted motion and on noise; structure against slow forms."""

import itertools
import math

import numpy as np
import pytest

from kinegrid.operators import registration as R
from kinegrid.operators import structure as S


def image(shape=(48, 40), seed=0):
    rng = np.random.default_rng(seed)
    return S.gaussian(rng.normal(size=shape), 2.5) * 10


def true_error(moving, reference, u):
    return float(((reference - R.warp(moving, u)) ** 2).mean())


def test_sample_against_corners():
    a = np.arange(24.0).reshape(2, 3, 4)
    assert R.sample(a, [np.array([0.5]), np.array([1.25]), np.array([2.0])])[0] == pytest.approx(0.5 * 12 + 1.25 * 4 + 2)
    assert R.sample(a, [np.array([9.0]), np.array([-3.0]), np.array([2.6])], nearest=True)[0] == a[1, 0, 3]
    assert R.resize(a, (2, 3, 4)) == pytest.approx(a)


def test_planted_shift():
    a = image()
    u = np.stack([np.full(a.shape, 1.4), np.full(a.shape, -0.8)])
    moved = R.warp(a, -u)
    got = R.flow(moved, a)
    inner = (slice(None), slice(8, -8), slice(8, -8))
    assert np.abs(got.field[inner] - u[inner]).mean() < 0.25
    assert got.after < 0.2 * got.before and got.after == pytest.approx(true_error(moved, a, got.field))
    assert got.before == pytest.approx(float(((a - moved) ** 2).mean()))


@pytest.mark.parametrize("seed", range(4))
def test_noise_is_never_made_worse(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, 40, 25))
    got = R.flow(a, b, layers=2, radius=3)
    assert got.after <= got.before and got.after == pytest.approx(true_error(a, b, got.field))


def test_start_and_weight():
    a = image(seed=3)
    u = np.stack([np.full(a.shape, 3.0), np.full(a.shape, 2.0)])
    moved = R.warp(a, -u)
    far = R.flow(moved, a, rounds=1, layers=1)
    near = R.flow(moved, a, rounds=1, layers=1, start=u)
    assert near.after < far.after
    broken = a.copy()
    broken[:10, :10] = 99
    w = np.ones(a.shape)
    w[:14, :14] = 0
    assert R.flow(moved, broken, weight=w).after < 0.5 * R.flow(moved, broken, weight=w).before


def test_planted_volume_shift():
    a = S.gaussian(np.random.default_rng(1).normal(size=(32, 30, 9)), 2.0) * 10
    u = np.stack([np.full(a.shape, 1.0), np.full(a.shape, -0.7), np.full(a.shape, 0.6)])
    moved = R.warp(a, -u)
    got = R.flow(moved, a, layers=2, radius=4, rounds=20)
    inner = (slice(None), slice(6, -6), slice(6, -6), slice(2, -2))
    assert np.abs(got.field[inner] - u[inner]).mean() < 0.3 and got.after < 0.25 * got.before


def test_slices_found_in_a_volume():
    ref = S.gaussian(np.random.default_rng(2).normal(size=(40, 36, 20)), 2.0) * 10
    z = np.array([4.0, 9.0, 14.0])
    x, y, k = R.places((40, 36, 3))
    moving = R.sample(ref, [x + 0.8, y - 0.5, z[k] + 0.9])
    moving[10:16, 10:16] += 3.0  # something that the reference lacks
    got = R.cross_flow(moving, ref, z, rounds=25)
    inner = (slice(20, -6), slice(20, -6))
    assert abs(got.field[0][inner].mean() - 0.8) < 0.3 and abs(got.field[2][inner].mean() - 0.9) < 0.35
    found = R.sample(ref, [p + d for p, d in zip([x, y, z[k]], got.field, strict=True)])
    plain = R.sample(ref, [x, y, z[k]])
    away = (slice(20, None), slice(20, None))
    assert got.after < got.before and ((moving - found)[away] ** 2).mean() < 0.2 * ((moving - plain)[away] ** 2).mean()
    noise = np.random.default_rng(3).normal(size=(40, 36, 3))
    worse = R.cross_flow(noise, ref, z, rounds=5)
    assert worse.after <= worse.before


def test_smooth_grid_is_the_least_of_its_objective():
    rng = np.random.default_rng(4)
    value, sure = rng.normal(size=(2, 6, 5))
    sure = sure**2
    z = R.smooth_grid(value, sure, 0.7, 4000, 0.0)
    n = 30
    a, b = np.zeros((n, n)), (sure * value).ravel()
    for i, j in itertools.product(range(6), range(5)):
        k = i * 5 + j
        a[k, k] += sure[i, j]
        for u, v in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if 0 <= u < 6 and 0 <= v < 5:
                a[k, k] += 0.7
                a[k, u * 5 + v] -= 0.7
    assert z.ravel() == pytest.approx(np.linalg.solve(a, b), abs=1e-6)


def test_a_drifting_recording():
    a = image((40, 36), 5)
    drift = [0.15 * (t - 12) for t in range(24)]
    frames = [R.warp(a, np.stack([np.full(a.shape, -d), np.zeros(a.shape)])) for d in drift]
    got = R.register_recording(frames, block=6, window=4, chunk=5, layers=2, rounds=15)
    assert len(got) == 24
    means = np.array([m.field[0][8:-8, 8:-8].mean() for m, _, _ in got])
    assert np.corrcoef(means, drift)[0, 1] > 0.98
    assert all(m.after <= m.before for m, _, _ in got)
    assert R.block_reference([a] * 4)[1][0] == 0


def test_bad_boxes():
    e = np.random.default_rng(6).normal(scale=0.1, size=(30, 30)) ** 2
    e[5:8, 20:23] = 5
    e[15, 3] = 5
    assert R.bad_boxes(e, 50.0, 2, 1) == [(slice(4, 9), slice(19, 24))]


@pytest.mark.parametrize("diagonal", [True, False])
def test_label_against_search(diagonal):
    mask = np.random.default_rng(7).random((12, 9, 3)) < 0.3
    got, n = S.label(mask, diagonal)
    seen, want = {}, 0
    for p in zip(*np.nonzero(mask), strict=True):
        if p in seen:
            continue
        want += 1
        todo = [p]
        seen[p] = want
        while todo:
            q = todo.pop()
            for o in itertools.product((-1, 0, 1), repeat=3):
                r = tuple(int(i + j) for i, j in zip(q, o, strict=True))
                if (diagonal or sum(map(abs, o)) == 1) and all(0 <= i < k for i, k in zip(r, mask.shape, strict=True)) and mask[r] and r not in seen:
                    seen[r] = want
                    todo.append(r)
    assert n == want and all(got[p] == k for p, k in seen.items()) and (got > 0).sum() == mask.sum()


def test_distances_and_edges():
    rng = np.random.default_rng(8)
    mask = rng.random((14, 11)) < 0.08
    at = np.argwhere(mask)
    want = np.array([[np.sqrt(((at - (i, j)) ** 2).sum(1)).min() for j in range(11)] for i in range(14)])
    assert S.distance_to(mask) == pytest.approx(want)
    a = np.zeros((30, 30))
    a[10:20, 10:20] = 1
    assert S.edge_distance(a, a, 0.07) == 0 and 1 < S.edge_distance(a, np.roll(a, 4, 0), 0.07) < 4


def test_blobs():
    a = np.zeros((40, 40))
    a[5:8, 5:8] = a[30:33, 20:23] = 9
    b = np.roll(a, 2, 0)
    assert S.blobs(a).tolist() == [[6, 6], [31, 21]]
    assert S.blob_match(S.blobs(a), S.blobs(b)) == (2.0, 1.0, 1.0)
    assert math.isnan(S.blob_match(S.blobs(a), np.zeros((0, 2)))[0])


def test_ball_and_growth():
    assert S.ball(3, 1.0).sum() == sum(x * x + y * y + z * z <= 9 for x, y, z in itertools.product(range(-3, 4), repeat=3))
    assert S.ball(4, 2.0).shape == (9, 9, 5) and S.ball(2, 0.5).shape == (5, 5, 9)
    with pytest.raises(ValueError):
        S.ball(2, 0)
    allowed = np.zeros((9, 9, 1), bool)
    allowed[4, :, 0] = allowed[:, 4, 0] = True
    seed = np.zeros_like(allowed)
    seed[4, 4, 0] = True
    cross = np.zeros((3, 3, 1), bool)
    cross[1, :, 0] = cross[:, 1, 0] = True
    assert S.grow(seed, allowed, cross, 2).sum() == 9 and S.grow(seed, allowed, cross, 50).sum() == 17


def test_difference_maps():
    a = image((60, 60), 9)
    b = R.warp(a, np.stack([np.full(a.shape, 2.5), np.zeros(a.shape)]))
    for f in (S.mind_difference, S.zscore_difference):
        assert f(a, a).max() == pytest.approx(0, abs=1e-9) and 0 < f(a, b).mean() <= 1
    assert S.reliability(np.ones((20, 20))).max() == 0 and 0 < S.reliability(a).mean() < 1
    mask, apart, trust = S.difference_mask(a, a)
    assert (mask == (trust >= 0.1)).all() and apart.max() < 1e-9
    step = np.ones((40, 40))
    step[20:] = 3
    m = S.michelson(step, 1.0, 4.0)
    assert m[20, 20] == pytest.approx(0.5, abs=0.02) and m[2, 2] == pytest.approx(0, abs=1e-6)


def test_order_statistics_against_simulation():
    rng = np.random.default_rng(10)
    side = rng.random(60) < np.linspace(0.1, 0.8, 60)  # ranks dealt to the two sides
    values = np.sort(rng.normal(size=(20000, 60)), axis=1)
    t = values[:, side].mean(1) - values[:, ~side].mean(1)
    mean, sd = S.order_statistics(np.flatnonzero(side).astype(float), np.flatnonzero(~side).astype(float))
    assert mean == pytest.approx(t.mean(), abs=0.03) and sd == pytest.approx(t.std(), rel=0.08)


def test_significance_finds_the_planted_spot():
    rng = np.random.default_rng(11)
    a = rng.normal(size=(50, 50))
    a[20:27, 30:37] += 3
    z = S.significance(a, np.arange(0.4, 3, 0.2))
    assert z[22:25, 32:35].min() > 5 and z[:10].max() < 5


def test_cubic_spline():
    a = np.random.default_rng(12).normal(size=(9, 7))
    x, y = R.places(a.shape)
    assert R.sample_cubic(a, [x, y]) == pytest.approx(a, abs=1e-9)
    t = np.linspace(0, 59, 301)
    wave = np.cos(np.arange(60) * math.pi / 59 * 3)
    assert R.sample_cubic(wave, [t]) == pytest.approx(np.cos(t * math.pi / 59 * 3), abs=1e-5)
    assert R.sample_cubic(wave, [np.array([-1.0, 3.0, 99.0])], outside=-7.0)[[0, 2]].tolist() == [-7.0, -7.0]
    # the spline's own condition: coefficients weigh 1/6, 4/6, 1/6 at an element
    c = R.spline_coefficients(wave)
    assert (c[:-2] + 4 * c[1:-1] + c[2:]) / 6 == pytest.approx(wave[1:-1])


def test_quality_loop():
    a = image((40, 36), 13)
    frames = [R.warp(a, np.stack([np.full(a.shape, 0.1 * t), np.zeros(a.shape)])) for t in range(10)]
    got = R.quality_loop(frames, a, every=4, layers=2, rounds=8)
    assert len(got) == 10 and all(r["error_after"] <= r["error_before"] and r["ncc"] > 0.95 and r["relative"] < 0.1 for r in got)
    x = np.array([[1.0, 2, 4], [3, 5, 9]])
    mae, relative, ncc = R.frame_metrics(x, x + 1, x > 2)
    assert mae == 1 and ncc == pytest.approx(1) and relative == pytest.approx(1 / np.subtract(*np.quantile(x, [0.99, 0.01])))
    assert R.frame_metrics(x, x, np.zeros(x.shape, bool))[0] == 0 and math.isnan(R.frame_metrics(x * 0, x, x > 0)[2])
