import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrid.operators import kernels as K
from kinegrid.operators import modes as M


def slow_dtw(x, y):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(1, len(x) + 1), range(1, len(y) + 1)):
        d[i, j] = abs(x[i - 1] - y[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1] / (len(x) + len(y))


floats = st.lists(st.floats(-5, 5), min_size=1, max_size=9)


@given(floats, floats)
@settings(max_examples=80, deadline=None)
def test_dtw(x, y):
    assert K.dtw(np.array(x), np.array(y)) == pytest.approx(slow_dtw(x, y))
    assert K.signed_dtw(np.array(x), -np.array(x))[0] == pytest.approx(0)


def test_dtw_of_nothing():
    assert K.dtw(np.array([]), np.array([1.0])) == math.inf


@pytest.mark.parametrize("method", ["complete", "single", "average"])
def test_linkage_finds_separated_groups(method):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, 6) for c in (0, 5, 9)])
    got = K.linkage_labels(np.abs(x[:, None] - x), 1.0, method)
    assert got.tolist() == [0] * 6 + [1] * 6 + [2] * 6


def test_sparse_linkage_equals_the_dense_one():
    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 30):
        for _ in range(10):
            d = np.round(rng.random((n, n)), 1)
            d = (d + d.T) / 2
            known = np.triu(rng.random((n, n)) < 0.6, 1)
            dense = np.where(known | known.T, d, 1e6)
            edges = [(float(d[i, j]), int(i), int(j)) for i, j in np.argwhere(known)]
            assert K.sparse_linkage(n, edges, 0.5).tolist() == K.linkage_labels(dense, 0.5).tolist()


def test_complete_linkage_does_not_chain():
    x = np.array([0.0, 0.6, 1.2])
    assert len(set(K.linkage_labels(np.abs(x[:, None] - x), 0.8))) == 2
    assert len(set(K.linkage_labels(np.abs(x[:, None] - x), 0.8, "single"))) == 1
    with pytest.raises(ValueError):
        K.linkage_labels(np.zeros((2, 2)), 1, "ward")


@given(st.integers(0, 12), st.integers(0, 12), st.floats(0.01, 0.99))
@settings(max_examples=60, deadline=None)
def test_binomial_tail(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert K.binomial_tail(k, n, p) == pytest.approx(want, abs=1e-12)


def test_binomial_edges():
    assert K.binomial_tail(0, 5, 0.0) == 1 and K.binomial_tail(3, 5, 0.0) == 0 and K.binomial_tail(3, 5, 1.0) == 1
    assert math.isnan(K.binomial_tail(1, 5, 1.5))


def test_local_median_odd_and_even():
    a = np.arange(24, dtype=float).reshape(4, 3, 2)
    got = K.local_median(a, (3, 1, 1))
    p = np.pad(a, [(1, 1), (0, 0), (0, 0)], mode="symmetric")
    assert (got == np.median(np.stack([p[i : i + 4] for i in range(3)]), axis=0)).all()
    assert K.local_median(np.array([[[1.0]], [[2.0]]]), (2, 1, 1)).ravel().tolist() == [1.0, 2.0]


def test_ssim():
    rng = np.random.default_rng(1)
    a = rng.random((20, 20))
    assert np.allclose(K.ssim_difference(a, a), 0) and K.ssim_difference(a, 1 - a).mean() > 0.5


def planted(noise=0.0):
    rng = np.random.default_rng(2)
    coords = np.stack(np.meshgrid(np.arange(8.0), np.arange(6.0), indexing="ij"), -1).reshape(-1, 2)
    h, b = rng.normal(size=(2, 30)), np.zeros((2, 48, 2))
    for k, at in enumerate(((1, 1), (6, 4))):
        near = np.hypot(*(coords - at).T) < 2
        b[k, near] = rng.normal(size=(near.sum(), 2)) + 3
    return np.einsum("kt,knd->tnd", h, b) + noise * rng.normal(size=(30, 48, 2)), coords, b


def test_modes_explain_a_planted_factorisation():
    y, coords, b = planted()
    m = M.fit_modes(y, coords, weight=1e-3, target=0.999)
    assert len(m.h) == 2 and m.explained > 0.99 and (np.diff(m.objective) <= 1e-12).all()
    assert {tuple(s) for s in m.support.tolist()} == {tuple(np.hypot(*x.T) > 0) for x in b}
    assert np.linalg.norm(m.h, axis=1) == pytest.approx(1)
    part = M.contributions(y, m)
    assert part.sum() == pytest.approx(1, abs=0.1) and (part > 0.1).all()


def test_compact_modes_are_smaller():
    y, coords, _ = planted(0.4)
    spread = []
    for kappa in (0.0, 200.0):
        m = M.fit_modes(y, coords, weight=0.05, kappa=kappa, keep=0.0, target=0.7)
        a = np.hypot(m.b[..., 0], m.b[..., 1])
        c = M.centres(m.b, coords, np.zeros((len(a), 2)))
        spread.append((a * ((coords[None] - c[:, None]) ** 2).sum(2)).sum() / a.sum())
    assert spread[1] < spread[0]


def test_seeds_and_ranks():
    y, coords, _ = planted()
    s = M.seeds(y, coords, 3, 3.0)
    assert len(set(s)) == 3 and all(np.hypot(*(coords[i] - coords[j])) >= 3 for i, j in itertools.combinations(s, 2))
    assert len(M.seeds(y, coords, 6, 100.0)) == 6
    assert M.energy_rank(y, 0.999)[0] == 2 and M.energy_rank(y, 0.999, 1)[0] == 1 and M.energy_rank(y * 0)[0] == 1
    still = M.fit_modes(y * 0, coords)
    assert still.explained <= 1 and np.isfinite(still.b).all()


@pytest.mark.parametrize("kernel", ["cubic", "triangle"])
def test_resize_weights(kernel):
    index, w = K.resize_weights(12, 12, kernel)
    a = np.arange(12.0)
    assert np.allclose((a[index] * w).sum(1), a)
    index, w = K.resize_weights(12, 5, kernel)
    assert np.allclose((np.ones(12)[index] * w).sum(1), 1)


def test_unified_trace_aligns_signs():
    t = np.sin(np.linspace(0, 3, 30))
    mean, signs, best = K.unified_trace([t, -t[:20], t * 2], np.ones(3))
    assert signs[best] == 1 and signs.tolist().count(-1) in (1, 2) and np.linalg.norm(mean) == pytest.approx(1)
    assert K.resample([0.0, 2.0], 3).tolist() == [0, 1, 2] and K.resample([], 4).tolist() == [0] * 4


def test_motion_field_has_the_amplitude():
    x, y = K.motion_field((30, 20), 1.5, 3, 1)
    assert x.std() == pytest.approx(1.5) and y.std() == pytest.approx(1.5) and abs(x.mean()) < 1e-9


def test_moving_discs_keep_their_light():
    a, b = K.moving_discs((40, 30), 4, 0, 3), K.moving_discs((40, 30), 4, 7, 3)
    assert (a == K.moving_discs((40, 30), 4, 0, 3)).all() and (a != b).any()
    assert set(np.unique(b)) <= {0.0} | set(np.unique(K.moving_discs((40, 30), 4, 0, 3))) | set(np.unique(b)) and 0.5 <= b[b > 0].min()
    late = [K.moving_discs((40, 30), 1, t, 5) for t in range(0, 400, 9)]
    assert all(x.any() for x in late)


def test_fields_of_limited_gradient_and_breathing():
    u = np.random.default_rng(0).normal(size=(2, 20, 16)) * 3
    got = K.limit_gradient(u, 0.2)
    assert max(np.abs(np.diff(got[k], axis=i)).max() for k in range(2) for i in range(2)) <= 0.2 + 1e-12
    assert (K.limit_gradient(got, 0.2) == got).all()
    wide = K.breathing((9, 7), 1 / 1.2, 2.0, 0.0)
    assert wide[0, -1, 0] == pytest.approx(2.0) and wide[1, 0, 0] == pytest.approx(-2.0)
    assert np.abs(K.breathing((9, 7), 0.4, 0.0, 0.5)).max() <= 0.5
