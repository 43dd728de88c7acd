"""Numeric kernels that no relational form expresses, in NumPy; plans run them once for each group."""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush

import numpy as np

from .registration import mean_box


def dtw(x: np.ndarray, y: np.ndarray) -> float:
    """Dynamic time warping distance with absolute cost, divided by the two lengths; infinite for an empty trace.

    Cells of one anti-diagonal depend on the two before it alone, so each is one array operation."""
    n, m = len(x), len(y)
    if not n or not m:
        return math.inf
    x, y = np.asarray(x, float), np.asarray(y, float)
    older, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by row, from 1; row 0 is the border
    older[0] = 0.0
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        now = np.full(n + 1, np.inf)
        now[i + 1] = np.abs(x[i] - y[k - i]) + np.minimum(np.minimum(last[i], last[i + 1]), older[i])
        older, last = last, now
    return float(last[n] / (n + m))


def signed_dtw(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """The smaller of the distances to y and to -y, and its sign."""
    plus, minus = dtw(x, y), dtw(x, -np.asarray(y, float))
    return (minus, -1) if minus < plus else (plus, 1)


def linkage_labels(distance: np.ndarray, cut: float, method: str = "complete") -> np.ndarray:
    """Agglomerative clusters of a distance matrix cut at a height, numbered by their first members."""
    join = {"complete": np.maximum, "single": np.minimum}
    if method not in ("complete", "single", "average"):
        raise ValueError("method must be complete, single or average: others may join what the cut keeps apart")
    d = np.array(distance, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    while alive.sum() > 1:
        flat = int(np.argmin(np.where(alive[:, None] & alive, d, np.inf)))
        i, j = min(divmod(flat, n)), max(divmod(flat, n))
        if not d[i, j] <= cut:
            break
        new = join[method](d[i], d[j]) if method in join else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == label[j]] = label[i]
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def sparse_linkage(n: int, edges: list[tuple[float, int, int]], cut: float) -> np.ndarray:
    """Complete linkage of n items cut at a height, from the distances (d, i, j) that are known; items without one never
    join. Memory follows the distances and not n squared; ties go to the lowest pair."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for d, i, j in edges:
        if i != j:
            near[i][j] = near[j][i] = d
    heap = [(d, min(i, j), max(i, j)) for i in range(n) for j, d in near[i].items() if i < j and d <= cut]
    heapify(heap)
    label = np.arange(n)
    members = [[i] for i in range(n)]
    while heap:
        d, i, j = heappop(heap)
        if near[i].get(j) != d or not members[i] or not members[j]:
            continue  # one of the two has grown or is gone
        for k in [k for k in near[i] if k not in near[j]] + [k for k in near[j] if k not in near[i]]:
            near[k].pop(i, None)
            near[k].pop(j, None)
        both = {k: max(x, near[j][k]) for k, x in near[i].items() if k in near[j]}
        for k, x in both.items():
            near[k].pop(j, None)
            near[k][i] = x
            if x <= cut:
                heappush(heap, (x, min(i, k), max(i, k)))
        near[i], near[j] = both, {}
        members[i] += members[j]
        members[j] = []
    for i, group in enumerate(members):
        label[group] = i
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for n trials; 1 for k <= 0, NaN for arguments that make no sense."""
    if n < 0 or not 0 <= p <= 1 or k > n and k > 0 and n < 0:
        return math.nan
    if k <= 0:
        return 1.0
    if k > n or p == 0:
        return 0.0
    if p == 1:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def local_median(a: np.ndarray, window: tuple[int, ...]) -> np.ndarray:
    """Median over a box around each element, borders reflected; even windows take the upper of the middle two."""
    before = [w // 2 for w in window]
    padded = np.pad(a, [(b, w - 1 - b) for b, w in zip(before, window, strict=True)], mode="symmetric")
    view = np.lib.stride_tricks.sliding_window_view(padded, window).reshape(*a.shape, -1)
    return np.partition(view, view.shape[-1] // 2, axis=-1)[..., view.shape[-1] // 2]


def rest_state(a: np.ndarray, time: int = 21, space: int = 5, scale: float = 5.0, most: int = 21) -> np.ndarray:
    """Local median plus scale times the local median deviation of a (t, x, y) magnitude."""
    med = local_median(a, (time, space, space))
    return med + scale * 1.4826 * local_median(np.abs(a - med), (min(most, max(1, len(a) // 4)), 1, 1))


def ssim_difference(a: np.ndarray, b: np.ndarray, radius: int = 5) -> np.ndarray:
    """1 - local structural similarity over boxes."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    span = max(float(max(a.max(), b.max()) - min(a.min(), b.min())), 1e-12)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    box = lambda x: mean_box(x, (radius,) * a.ndim)
    ma, mb = box(a), box(b)
    va, vb = box((a - ma) ** 2), box((b - mb) ** 2)
    ab = box((a - ma) * (b - mb))
    return 1 - (2 * ma * mb + c1) * (2 * ab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def resize_weights(size: int, out: int, kernel: str = "cubic") -> tuple[np.ndarray, np.ndarray]:
    """Source indices and weights (out, taps) of antialiased resizing along one axis, borders mirrored."""
    def cubic(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        return np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x <= 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))

    shape, width = {"cubic": (cubic, 4.0), "triangle": (lambda x: np.maximum(0, 1 - np.abs(x)), 2.0)}[kernel]
    scale = out / size
    narrow = min(scale, 1.0)
    width /= narrow
    centre = (np.arange(out) + 0.5) / scale - 0.5
    first = np.floor(centre - width / 2).astype(int)
    index = first[:, None] + np.arange(int(np.ceil(width)) + 2)
    w = narrow * shape(narrow * (centre[:, None] - index))
    w /= w.sum(1, keepdims=True)
    index = np.mod(index, 2 * size)
    return np.where(index < size, index, 2 * size - 1 - index), w


def resample(x: np.ndarray, n: int = 16) -> np.ndarray:
    """Linear resampling to n points, endpoints included."""
    x = np.asarray(x, float)
    return np.interp(np.linspace(0, max(len(x) - 1, 0), n), np.arange(len(x)), x) if len(x) else np.zeros(n)


def unified_trace(traces: list[np.ndarray], weights: np.ndarray, n: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """Weighted mean of resampled traces, signs aligned with the medoid's, at unit norm; the signs; the medoid's number.

    The medoid has the least weighted sum of sign-aware warping distances to the others; the first of equals."""
    r = [resample(t, n) for t in traces]
    d = np.array([[0.0 if i == j else signed_dtw(a, b)[0] for j, b in enumerate(r)] for i, a in enumerate(r)])
    best = int(np.argmin((d * weights).sum(1)))
    centred = [x - x.mean() for x in r]
    signs = np.array([-1 if float(x @ centred[best]) < 0 else 1 for x in centred])
    mean = (np.array(r) * (signs * weights)[:, None]).sum(0) / max(float(weights.sum()), 1e-12)
    size = float(np.linalg.norm(mean))
    return (mean / size if size > 1e-12 else mean), signs, best


def motion_field(shape: tuple[int, int], amplitude: float, radius: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A smooth random displacement field; each component is scaled by its own spread."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(2):
        f = mean_box(mean_box(rng.normal(size=shape), (radius, radius)), (radius, radius))
        out.append(amplitude * (f - f.mean()) / max(float(f.std()), 1e-12))
    return out[0], out[1]


def best_correlations(a: np.ndarray, b: np.ndarray, ids: np.ndarray, others: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a the n rows of b with the highest correlation (to 9 digits, first ids win), itself left out."""
    unit = [x - x.mean(1, keepdims=True) for x in (a, b)]
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = [x / np.sqrt((x * x).sum(1, keepdims=True)) for x in unit]
    out: list[list[np.ndarray]] = [[], [], []]
    for lo in range(0, len(a), 512):
        r = np.round(unit[0][lo : lo + 512] @ unit[1].T, 9)
        r[(ids[lo : lo + 512, None] == others) | np.isnan(r)] = -np.inf
        best = np.argsort(-r, axis=1, kind="stable")[:, :n]
        got = np.take_along_axis(r, best, 1)
        row, k = np.nonzero(np.isfinite(got))
        for column, x in zip(out, (ids[lo + row], others[best[row, k]], got[row, k]), strict=True):
            column.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def moving_discs(shape: tuple[int, int], n: int, t: int, seed: int, radius: float = 4.0, speed: float = 1.5) -> np.ndarray:
    """A frame of n discs of their own brightness; each keeps its course and turns at the borders. A function of the
    seed and the time alone."""
    rng = np.random.default_rng(seed)
    x, y = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape)
    for _ in range(n):
        at, angle, light = rng.random(2) * shape, rng.random() * 2 * math.pi, 0.5 + 0.5 * rng.random()
        place = at + t * speed * np.array([math.cos(angle), math.sin(angle)])
        folded = [abs((p + m) % (2 * m) - m) if m else 0.0 for p, m in zip(place, (shape[0] - 1, shape[1] - 1), strict=True)]
        out = np.maximum(out, light * ((x - folded[0]) ** 2 + (y - folded[1]) ** 2 <= radius * radius))
    return out


def limit_gradient(u: np.ndarray, most: float, rounds: int = 500) -> np.ndarray:
    """A field smoothed until no component changes by more than ``most`` from one element to the next."""
    u = np.asarray(u, float).copy()
    for _ in range(rounds):
        if all(np.abs(np.diff(d, axis=i)).max(initial=0) <= most for d in u for i in range(d.ndim)):
            return u
        u = np.stack([mean_box(d, (1,) * d.ndim) for d in u])
    worst = max(np.abs(np.diff(d, axis=i)).max(initial=0) for d in u for i in range(d.ndim))
    return u * min(1.0, most / max(worst, 1e-300))


def breathing(shape: tuple[int, int], t: float, slow: float, fast: float, rate: float = 0.3, beat: float = 2.0) -> np.ndarray:
    """A body's motion at a time: a slow widening around the middle and a faster wave along the first axis."""
    x, y = np.meshgrid(*(np.linspace(-1, 1, n) for n in shape), indexing="ij")
    wide, wave = slow * math.sin(2 * math.pi * rate * t), fast * np.sin(2 * math.pi * (beat * t - x))
    return np.stack([wide * x + wave, wide * y])
