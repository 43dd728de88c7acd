"""Structure of images in NumPy: filters, components, edges, blobs, growth, difference maps and significance."""

from __future__ import annotations

import math
from itertools import product
from statistics import NormalDist

import numpy as np


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter of four sigmas on each side, borders mirrored."""
    r = int(4 * sigma + 0.5)
    if not r:
        return np.asarray(a, float)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return correlate(a, [w / w.sum()] * a.ndim, "symmetric")


def correlate(a: np.ndarray, weights: list[np.ndarray | None], mode: str = "edge") -> np.ndarray:
    """Correlation with odd weights along each axis; mode: how borders go on (edge, symmetric, reflect, wrap, constant)."""
    a = np.asarray(a, float)
    for axis, w in enumerate(weights):
        if w is not None:
            r = len(w) // 2
            p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode=mode)
            a = sum(c * np.take(p, range(i, i + a.shape[axis]), axis) for i, c in enumerate(w))
    return a


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives along both axes, smoothed across, borders repeated."""
    rise, across = np.array([-1.0, 0, 1]), np.array([1.0, 2, 1])
    return correlate(a, [rise, across]), correlate(a, [across, rise])


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Components of a mask in any number of dimensions, numbered from 1 in the order of their first elements."""
    mask = np.asarray(mask, bool)
    at = np.flatnonzero(mask)
    node = np.full(mask.shape, -1)
    node.ravel()[at] = np.arange(len(at))
    links = []
    for shift in product((-1, 0, 1), repeat=mask.ndim):
        if shift <= (0,) * mask.ndim or not diagonal and sum(map(abs, shift)) != 1:
            continue
        here = tuple(slice(max(0, -s), n - max(0, s)) for s, n in zip(shift, mask.shape, strict=True))
        there = tuple(slice(max(0, s), n - max(0, -s)) for s, n in zip(shift, mask.shape, strict=True))
        both = mask[here] & mask[there]
        links.append((node[here][both], node[there][both]))
    least = np.arange(len(at))
    a, b = (np.concatenate([x[i] for x in links]) for i in (0, 1))
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            break
    names, number = np.unique(least, return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out.ravel()[at] = number + 1
    return out, len(names)


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each element of a 2-D array to the nearest of a mask."""
    h, w = mask.shape
    rows = np.arange(h)
    down = np.full((h, w), np.inf)  # squared distance inside the column
    for j in range(w):
        at = np.flatnonzero(mask[:, j])
        if len(at):
            down[:, j] = np.abs(rows[:, None] - at).min(1) ** 2
    across = (np.arange(w)[:, None] - np.arange(w)) ** 2
    return np.sqrt((down[:, None, :] + across).min(2))


def edge_distance(a: np.ndarray, b: np.ndarray, share: float = 0.1) -> float:
    """Mean distance, both ways, between the strongest edges of two images (the given share of the elements)."""
    edges = []
    for x in (a, b):
        strength = np.sqrt(sum(g * g for g in sobel(x)) + 1e-8)
        edges.append(strength >= np.quantile(strength, 1 - share))
    if not all(e.any() for e in edges):
        return math.nan
    return 0.5 * float(distance_to(edges[1])[edges[0]].mean() + distance_to(edges[0])[edges[1]].mean())


def blobs(a: np.ndarray, sigmas: float = 3.0) -> np.ndarray:
    """Centres (n, 2) of the components (four neighbours) above the mean by so many standard deviations."""
    numbers, n = label(a > a.mean() + sigmas * a.std(), diagonal=False)
    return np.array([[i.mean() for i in np.nonzero(numbers == k)] for k in range(1, n + 1)]).reshape(-1, 2)


def blob_match(a: np.ndarray, b: np.ndarray, radius: float = 5.0) -> tuple[float, float, float]:
    """Mean nearest distance both ways, recall and precision within the radius; NaN where a side has no blob."""
    if not len(a) or not len(b):
        return (math.nan,) * 3
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    there, back = d.min(1), d.min(0)
    return 0.5 * float(there.mean() + back.mean()), float((there <= radius).mean()), float((back <= radius).mean())


def ball(radius: int, z_ratio: float, most: int = 64) -> np.ndarray:
    """A ball of physical radius for voxels z_ratio units thick; at least one plane to each side, at most ``most``."""
    if not (math.isfinite(z_ratio) and z_ratio > 0):
        raise ValueError("z_ratio must be positive and finite")
    radius = max(1, int(radius))
    depth = max(1, min(math.ceil(radius / z_ratio), most))
    x, y, z = np.meshgrid(*(np.arange(-r, r + 1) for r in (radius, radius, depth)), indexing="ij")
    return x * x + y * y + (z * z_ratio) ** 2 <= radius * radius + 1e-6


def dilate(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    r = [n // 2 for n in element.shape]
    p = np.pad(mask, [(i, i) for i in r])
    out = np.zeros_like(mask)
    for o in zip(*np.nonzero(element), strict=True):
        out |= p[tuple(slice(i, i + n) for i, n in zip(o, mask.shape, strict=True))]
    return out


def grow(seed: np.ndarray, allowed: np.ndarray, element: np.ndarray, steps: int) -> np.ndarray:
    """A seed dilated inside the allowed elements, step by step, until it grows no more or steps run out."""
    region = seed.copy()
    for _ in range(steps):
        larger = dilate(region, element) & allowed
        if (larger == region).all():
            break
        region = larger
    return region


def michelson(a: np.ndarray, sigma: float = 3.0, reach: float = 6.0, eps: float = 1e-6) -> np.ndarray:
    """Edge contrast: difference over sum of the smoothed values on both sides along the gradient."""
    from .registration import places, sample

    s = gaussian(a, sigma)
    g = sobel(s)
    size = np.sqrt(g[0] ** 2 + g[1] ** 2) + eps
    x, y = places(a.shape)
    ahead, behind = (sample(s, [x + k * reach * g[0] / size, y + k * reach * g[1] / size]) for k in (1, -1))
    return np.abs((ahead - behind) / (ahead + behind + eps))


def mind(a: np.ndarray, sigma: float = 1.5, offset: int = 5, eps: float = 1e-6) -> np.ndarray:
    """Self-similarity by direction (8, x, y): exp of minus the patch distances to eight shifted copies over their mean."""
    a = np.asarray(a, float)
    p = np.pad(a, offset, mode="edge")
    out = []
    for i, j in product((-offset, 0, offset), repeat=2):
        if i or j:
            moved = p[offset + i : offset + i + a.shape[0], offset + j : offset + j + a.shape[1]]
            out.append(gaussian((a - moved) ** 2, sigma))
    d = np.stack(out)
    return np.exp(-d / (d.mean(0) + eps))


def mind_difference(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, offset: int = 5, tau: float = 0.6, beta: float = 0.05) -> np.ndarray:
    """0 where two images agree in structure or have none, up to 1 where they differ."""
    m = [mind(x, sigma, offset) for x in (a, b)]
    weight = np.maximum(*(1 / (1 + np.exp(-(gaussian(x.mean(0), sigma) - tau) / beta)) for x in m))
    return np.clip(np.abs((m[0] - m[1]).mean(0)) * weight, 0, 1)


def zscore_difference(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, mean_part: float = 0.2, spread_part: float = 0.4, most: float = 10.0, eps: float = 1e-6) -> np.ndarray:
    """Difference of local means in local standard deviations, where either image has signal and spread; cut, 0 to 1."""
    mean, spread, mask = [], [], np.zeros(a.shape, bool)
    for x in (np.asarray(a, float), np.asarray(b, float)):
        m = gaussian(x, sigma)
        v = np.maximum(gaussian(x * x, sigma) - m * m, 0)
        mask |= (m > np.quantile(m, mean_part)) & (v > np.quantile(v, spread_part))
        mean.append(m)
        spread.append(v)
    return np.clip(np.abs(mean[0] - mean[1]) / (np.sqrt(spread[0] + spread[1]) + eps) * mask, 0, most) / most


def reliability(a: np.ndarray, sigma: float = 1.5, outlier: float = 5.0, eps: float = 1e-6) -> np.ndarray:
    """Local variance over its 95th percentile, cut at 1; 0 at outliers and in flat images."""
    a = np.asarray(a, float)
    m = gaussian(a, sigma)
    v = np.maximum(gaussian(a * a, sigma) - m * m, 0)
    scale = float(np.quantile(v, 0.95))
    if scale < eps:
        return np.zeros(a.shape)
    middle = np.median(a)
    spread = 1.4826 * np.median(np.abs(a - middle)) + eps
    return np.where(np.abs(a - middle) / spread > outlier, 0.0, np.clip(v / (scale + eps), 0, 1))


def difference_mask(reference: np.ndarray, moving: np.ndarray, most: float = 0.3, least: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements that are reliable and agree: (mask, difference, reliability)."""
    trust = np.minimum(reliability(reference), reliability(moving))
    apart = mind_difference(reference, moving)
    return (trust >= least) & (apart <= most), apart, trust


def order_statistics(inside: np.ndarray, outside: np.ndarray) -> tuple[float, float]:
    """Mean and standard deviation of mean(inside) - mean(outside) if all values were one normal sample (mean 0,
    deviation 1) that happens to be dealt to the two sides in this order of ranks.

    The difference is a linear form of order statistics, whose weight over ranks is a step function J: n / M on the
    inside's ranks, -n / N on the outside's. With q the normal quantile of a step's ends and F the integral of the
    normal distribution function, its mean is the integral of J q and its variance 2 / n times the integral of
    J(s) J(t) s (1 - t) dq dq over s < t, both in closed form by steps."""
    m, n = len(inside), len(outside)
    side = np.argsort(np.concatenate([outside, inside]), kind="stable") >= n
    cut = np.append(np.flatnonzero(side[1:] != side[:-1]) + 1, m + n)
    first = np.append(0, cut[:-1])
    j = np.where(side[first], (m + n) / m, -(m + n) / n)
    normal = NormalDist()
    edge = 1e-9  # the ends of the ranks, where the quantile is infinite and the integrands vanish
    a, b = (np.array([normal.inv_cdf(min(max(x / (m + n), edge), 1 - edge)) for x in ends]) for ends in (first, cut))
    phi = lambda q: np.exp(-q * q / 2) / math.sqrt(2 * math.pi)
    cdf = lambda q: np.array([normal.cdf(x) for x in q])
    one = lambda q: q * cdf(q) + phi(q)
    two = lambda q: ((q * q + 1) * cdf(q) + q * phi(q)) / 2
    mean = float((j * (phi(a) - phi(b))).sum())
    rise = one(b) - one(a)
    fall = (b - a) - rise
    between = float((np.append(0, np.cumsum(j * rise)[:-1]) * j * fall).sum())
    within = two(b) - two(a) - (one(b) ** 2 - one(a) ** 2) / 2 - one(a) * fall
    return mean, math.sqrt(max(0.0, 2 * (between + float((j * j * within).sum())) / (m + n)))


def significance(a: np.ndarray, thresholds: np.ndarray, least: int = 10, most: int = 10_000, sigma: float = 1.0, ring: int = 2, spread: float | None = None) -> np.ndarray:
    """Largest z-score by element over the components above each threshold: a component against the ring around it,
    beyond what the ranks alone would give. spread: the noise's standard deviation, by default from differences."""
    s = gaussian(a, sigma)
    if spread is None:
        spread = 1.4826 * float(np.median(np.abs(np.diff(a, axis=0)))) / math.sqrt(2)
    out = np.zeros(a.shape)
    element = np.ones((2 * ring + 1,) * a.ndim, bool)
    for level in sorted(thresholds, reverse=True):
        numbers, n = label(s > level)
        for k in range(1, n + 1):
            region = numbers == k
            size = int(region.sum())
            around = dilate(region, element) & ~region
            if not least <= size <= most or not around.any():
                continue
            mean, sd = order_statistics(a[region], a[around])
            z = (a[region].mean() - a[around].mean() - mean * spread) / max(sd * spread, 1e-12)
            if z > out[region].max():
                out[region] = z
    return out
