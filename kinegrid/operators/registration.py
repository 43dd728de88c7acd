"""Registration of images and volumes in NumPy: pyramid flow, cross-resolution flow, and the scan of a recording.

Arrays are (x, y) or (x, y, z); a field u has one array for each axis, with moving(p + u(p)) = reference(p). Every
result is scored at full resolution and is the best of what was tried, the start and no motion among it, so
registering never makes an image worse by its own measure.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import product

import numpy as np

from .structure import label


def sample(a: np.ndarray, at: list[np.ndarray], nearest: bool = False) -> np.ndarray:
    """Values at fractional places, linear between elements or of the nearest one, clamped to the array."""
    at = [np.clip(p, 0, n - 1) for p, n in zip(at, a.shape, strict=True)]
    if nearest:
        return a[tuple(np.rint(p).astype(int) for p in at)]
    low = [np.minimum(p.astype(int), max(n - 2, 0)) for p, n in zip(at, a.shape, strict=True)]
    part = [p - q for p, q in zip(at, low, strict=True)]
    out = np.zeros(np.broadcast(*at).shape)
    for corner in product((0, 1), repeat=a.ndim):
        w = np.ones(out.shape)
        for c, f in zip(corner, part, strict=True):
            w = w * (f if c else 1 - f)
        out += w * a[tuple(np.minimum(q + c, n - 1) for q, c, n in zip(low, corner, a.shape, strict=True))]
    return out


def spline_coefficients(a: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients with mirrored borders, by the recursive filter along each axis."""
    pole = math.sqrt(3) - 2
    c = np.asarray(a, float)
    for axis in range(c.ndim):
        n = c.shape[axis]
        if n < 2:
            continue
        c = np.moveaxis(c, axis, 0).copy()
        k = np.arange(min(n, 40))
        first = np.tensordot(pole ** k, c[k], 1) if n > 40 else np.tensordot(pole ** np.arange(2 * n - 2), c[np.r_[0:n, n - 2 : 0 : -1]], 1) / (1 - pole ** (2 * n - 2))
        c *= 6
        c[0] = 6 * first
        for i in range(1, n):
            c[i] += pole * c[i - 1]
        c[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
        for i in range(n - 2, -1, -1):
            c[i] = pole * (c[i + 1] - c[i])
        c = np.moveaxis(c, 0, axis)
    return c


def sample_cubic(a: np.ndarray, at: list[np.ndarray], outside: float | None = None) -> np.ndarray:
    """Values of the cubic spline through the elements, places clamped to the array or, beyond it, ``outside``."""
    c = spline_coefficients(a)
    inside = np.ones(np.broadcast(*at).shape, bool)
    for p, n in zip(at, a.shape, strict=True):
        inside &= (p >= 0) & (p <= n - 1)
    at = [np.clip(p, 0, n - 1) for p, n in zip(at, a.shape, strict=True)]
    base = [np.floor(p).astype(int) for p in at]
    out = np.zeros(inside.shape)
    shape = lambda x: np.where(x < 1, 2 / 3 - x * x + x**3 / 2, np.where(x < 2, (2 - x) ** 3 / 6, 0.0))
    for tap in product(range(-1, 3), repeat=a.ndim):
        w, index = np.ones(inside.shape), []
        for p, b, k, n in zip(at, base, tap, a.shape, strict=True):
            i = b + k
            w = w * shape(np.abs(p - i))
            i = np.abs(i) % max(2 * n - 2, 1)  # mirrored at the elements themselves
            index.append(np.where(i < n, i, 2 * n - 2 - i))
        out += w * c[tuple(index)]
    return out if outside is None else np.where(inside, out, outside)


def places(shape: tuple[int, ...]) -> list[np.ndarray]:
    return list(np.meshgrid(*map(np.arange, shape), indexing="ij"))


def warp(a: np.ndarray, u: np.ndarray) -> np.ndarray:
    return sample(a, [p + d for p, d in zip(places(a.shape), u, strict=True)])


def resize(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Linear samples on an endpoint-inclusive grid of another size."""
    return sample(a, list(np.meshgrid(*(np.linspace(0, n - 1, m) for n, m in zip(a.shape, shape, strict=True)), indexing="ij")))


def resize_field(u: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A field on another grid; displacements scale with their axes."""
    scale = [max(m - 1, 1) / max(n - 1, 1) for n, m in zip(u.shape[1:], shape, strict=True)]
    return np.stack([resize(d, shape) * s for d, s in zip(u, scale, strict=True)])


def mean_box(a: np.ndarray, radius: tuple[int, ...]) -> np.ndarray:
    """Means over 2 r + 1 elements of each axis, borders repeated."""
    for axis, r in enumerate(radius):
        if r:
            n = a.shape[axis]
            pad = [(r + 1, r) if i == axis else (0, 0) for i in range(a.ndim)]
            p = np.pad(a, pad, mode="edge").cumsum(axis)
            a = (np.take(p, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(p, range(n), axis)) / (2 * r + 1)
    return a


def halve(a: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 in the first two axes; an odd last row or column is left out."""
    h, w = (n // 2 * 2 for n in a.shape[:2])
    return a[:h, :w].reshape(h // 2, 2, w // 2, 2, *a.shape[2:]).mean((1, 3))


def smooth_grid(value: np.ndarray, confidence: np.ndarray, lam: float = 1.0, rounds: int = 40, eps: float = 1e-6) -> np.ndarray:
    """Confidence-weighted smoothing of a 2-D grid: Jacobi steps towards the least of
    sum confidence (z - value)^2 + lam sum over neighbours (z - z')^2, borders repeated."""
    z = np.asarray(value, float).copy()
    for _ in range(rounds):
        p = np.pad(z, 1, mode="edge")
        near = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
        z = (confidence * value + lam * near) / (confidence + 4 * lam + eps)
    return z


def step_of(gradients: list[np.ndarray], rest: np.ndarray, weight: np.ndarray, radius: tuple[int, ...], smooth: float, most: float) -> np.ndarray:
    """The limited step of every neighbourhood: its regularised normal equations, solved in closed form."""
    d = len(gradients)
    a, b = np.empty((*rest.shape, d, d)), np.empty((*rest.shape, d))
    floor = smooth * np.mean([np.mean(weight * g * g) for g in gradients]) + 1e-9
    for i in range(d):
        b[..., i] = mean_box(weight * gradients[i] * rest, radius)
        for j in range(i, d):
            a[..., i, j] = a[..., j, i] = mean_box(weight * gradients[i] * gradients[j], radius)
        a[..., i, i] += floor
    return np.clip(np.moveaxis(np.linalg.solve(a, b[..., None])[..., 0], -1, 0), -most, most)


def gradients_of(a: np.ndarray) -> list[np.ndarray]:
    return [np.gradient(a, axis=i) if n > 1 else np.zeros_like(a) for i, n in enumerate(a.shape)]


@dataclass
class Motion:
    """A field, and the mean squared errors at full resolution: without motion, of the start, of each layer, of the field."""

    field: np.ndarray
    before: float
    after: float
    layers: list[float] = field(default_factory=list)


def _penalty(u: np.ndarray) -> np.ndarray:
    """A field's neighbourhood mean, towards which it is pulled."""
    return np.stack([mean_box(d, tuple(1 if n > 1 else 0 for n in d.shape)) for d in u])


def flow(moving: np.ndarray, reference: np.ndarray, layers: int = 3, radius: int = 5, rounds: int = 12, smooth: float = 0.05, step: float = 1.0, tolerance: float = 1e-3, start: np.ndarray | None = None, weight: np.ndarray | None = None) -> Motion:
    """Coarse to fine in the first two axes. Each round warps, solves the neighbourhoods' normal equations, limits the
    step and pulls the field towards its neighbourhood mean; a layer stops when it gains no more and hands on its best
    field. weight: 0 where elements do not count."""
    mov, ref = np.asarray(moving, float), np.asarray(reference, float)
    w = np.ones(ref.shape) if weight is None else np.asarray(weight, float)
    reach = (radius, radius, 1)[: ref.ndim]

    def error(m: np.ndarray, r: np.ndarray, k: np.ndarray, u: np.ndarray) -> float:
        return float((k * (r - warp(m, u)) ** 2).sum() / max(float(k.sum()), 1e-12))

    pyramid = [(mov, ref, w)]
    while len(pyramid) < layers and min(pyramid[-1][0].shape[:2]) >= 16:
        pyramid.append(tuple(map(halve, pyramid[-1])))
    none = np.zeros((ref.ndim, *ref.shape))
    best = Motion(none, error(*pyramid[0], none), error(*pyramid[0], none))
    if start is not None:
        at = error(*pyramid[0], start)
        if at < best.after:
            best.field, best.after = np.asarray(start, float).copy(), at
    u = resize_field(best.field, pyramid[-1][0].shape)
    for mov, ref, w in reversed(pyramid):
        u = resize_field(u, mov.shape) if u.shape[1:] != mov.shape else u
        kept, least = u, error(mov, ref, w, u)
        for _ in range(rounds):
            warped = warp(mov, u)
            u = u + step_of(gradients_of(warped), ref - warped, w, reach, smooth, step)
            u = (1 - smooth) * u + smooth * _penalty(u)
            now = error(mov, ref, w, u)
            if now >= least * (1 - tolerance):
                if now < least:
                    kept, least = u, now
                break
            kept, least = u, now
        u = kept
        whole = resize_field(u, best.field.shape[1:]) if u.shape != best.field.shape else u
        at = error(*pyramid[0], whole)
        best.layers.append(at)
        if at < best.after:
            best.field, best.after = whole, at
    return best


def bad_boxes(error: np.ndarray, most: float = 3.0, least: int = 2, pad: int = 2) -> list[tuple[slice, ...]]:
    """Boxes around the components (four neighbours, ``least`` elements at least) of a map's outliers by MAD."""
    middle = np.median(error)
    spread = 1.4826 * np.median(np.abs(error - middle))
    numbers, n = label(error > middle + most * spread if spread > 0 else error > middle, diagonal=False)
    out = []
    for k in range(1, n + 1):
        where = np.nonzero(numbers == k)
        if len(where[0]) >= least:
            out.append(tuple(slice(max(0, int(i.min()) - pad), int(i.max()) + pad + 1) for i in where))
    return out


def cross_flow(moving: np.ndarray, reference: np.ndarray, z: np.ndarray, layers: int = 3, radius: int = 4, rounds: int = 12, smooth: float = 0.05, step: float = 1.0, lam: float = 0.5, tolerance: float = 1e-3, reruns: int = 2) -> Motion:
    """Slices of a coarse stack found in a finer volume.

    moving is (x, y, k); slice k lies near plane z[k] of reference (x, y, planes). The field, on the moving grid, moves
    the places at which the reference is sampled: reference(p + u(p)) = moving(p). Depth steps are smoothed over the
    grid by how much the reference says about depth there. After the last layer, regions whose local error is an
    outlier are solved again from their surroundings' motion; what lowers the error there is kept."""
    moving, reference = np.asarray(moving, float), np.asarray(reference, float)
    pyramid = [(moving, reference)]
    while len(pyramid) < layers and min(pyramid[-1][0].shape[:2]) >= 16:
        pyramid.append(tuple(map(halve, pyramid[-1])))
    reach = (radius, radius, 0)

    def sampled(a: np.ndarray, u: np.ndarray) -> np.ndarray:
        x, y, k = places(u.shape[1:])
        return sample(a, [x + u[0], y + u[1], z[k] + u[2]])

    def error(mov: np.ndarray, ref: np.ndarray, u: np.ndarray) -> float:
        return float(((mov - sampled(ref, u)) ** 2).mean())

    def solved(mov: np.ndarray, ref: np.ndarray, u: np.ndarray, weight: np.ndarray) -> np.ndarray:
        slopes = gradients_of(ref)
        kept, least = u, float((weight * (mov - sampled(ref, u)) ** 2).sum())
        for _ in range(rounds):
            rest = mov - sampled(ref, u)
            g = [sampled(s, u) for s in slopes]
            move = step_of(g, rest, weight, reach, smooth, step)
            sure = mean_box(g[2] ** 2, reach)
            sure = sure / max(float(sure.max()), 1e-12)
            for k in range(move.shape[-1]):
                move[2, :, :, k] = smooth_grid(move[2, :, :, k], sure[:, :, k], lam)
            u = u + move
            u = (1 - smooth) * u + smooth * np.stack([mean_box(d, (1, 1, 0)) for d in u])
            now = float((weight * (mov - sampled(ref, u)) ** 2).sum())
            if now >= least * (1 - tolerance):
                break
            kept, least = u, now
        return kept

    none = np.zeros((3, *moving.shape))
    best = Motion(none, error(moving, reference, none), error(moving, reference, none))
    u = np.zeros((3, *pyramid[-1][0].shape))
    for mov, ref in reversed(pyramid):
        u = resize_field(u, mov.shape) if u.shape[1:] != mov.shape else u
        u = solved(mov, ref, u, np.ones(mov.shape))
        whole = resize_field(u, moving.shape) if u.shape != none.shape else u
        at = error(moving, reference, whole)
        best.layers.append(at)
        if at < best.after:
            best.field, best.after = whole, at
    for _ in range(reruns):
        local = mean_box((moving - sampled(reference, best.field)) ** 2, reach)
        boxes = bad_boxes(local.mean(2))
        if not boxes:
            break
        for where in boxes:
            inside = np.zeros(moving.shape)
            inside[where] = 1.0
            around = best.field.copy()
            outer = tuple(slice(max(0, s.start - radius), s.stop + radius) for s in where)
            for d in around:
                ring = np.ones(d[outer].shape, bool)
                ring[tuple(slice(s.start - o.start, s.stop - o.start) for s, o in zip(where, outer, strict=True))] = False
                if ring.any():
                    d[where] = np.median(d[outer][ring])
            again = solved(moving, reference, around, inside)
            merged = np.where(inside > 0, again, best.field)
            at = error(moving, reference, merged)
            if at < best.after:
                best.field, best.after = merged, at
    return best


def scan(frames: list[np.ndarray], reference: np.ndarray, window: int = 5, chunk: int = 10, decay: float = 0.7, **options) -> list[tuple[Motion, np.ndarray, np.ndarray]]:
    """Frames of one direction in order: (motion, registered frame, reference used). The reference is the mean of the
    last ``window`` registered frames, renewed when a chunk begins; the motion of a frame, times decay, starts the next."""
    kept, out, start = [reference], [], None
    for i, frame in enumerate(frames):
        if i % chunk == 0 and len(kept) > 1:
            reference = np.mean(kept[-window:], axis=0)
        motion = flow(frame, reference, start=start, **options)
        straight = warp(np.asarray(frame, float), motion.field)
        start = decay * motion.field
        kept = [*kept[-window:], straight]
        out.append((motion, straight, reference))
    return out


def block_reference(frames: list[np.ndarray], near: int = 5) -> tuple[np.ndarray, list[int]]:
    """The mean of the frame that correlates best with its ``near`` nearest others and of these, and their numbers."""
    from .kernels import best_correlations

    flat = np.array([np.ravel(f) for f in frames], float)
    ids = np.arange(len(flat))
    i, j, r = best_correlations(flat, flat, ids, ids, min(near, max(len(flat) - 1, 1)))
    if not len(i):
        return np.asarray(frames[0], float), [0]
    score = np.bincount(i, r, len(flat)) / np.maximum(np.bincount(i, minlength=len(flat)), 1)
    score[np.bincount(i, minlength=len(flat)) == 0] = -np.inf
    first = int(np.argmax(score))
    chosen = [first, *j[i == first].tolist()]
    return np.mean([np.asarray(frames[k], float) for k in chosen], axis=0), chosen


def register_recording(frames: list[np.ndarray], block: int = 10, **options) -> list[tuple[Motion, np.ndarray, np.ndarray]]:
    """A recording from its middle: the middle block gives the first reference, and two scans go forwards from the
    block's begin and backwards from the frame before it."""
    middle = max(0, len(frames) // 2 - block // 2)
    reference, _ = block_reference(frames[middle : middle + block])
    forwards = scan(frames[middle:], reference, **options)
    backwards = scan(frames[:middle][::-1], reference, **options)
    return [*backwards[::-1], *forwards]


def frame_metrics(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> tuple[float, float, float]:
    """Mean absolute error where the mask holds (everywhere if nowhere), that over b's spread between its 1st and 99th
    percentile, and the correlation; NaN where a spread is 0."""
    x, y = (a[mask], b[mask]) if mask.any() else (a.ravel(), b.ravel())
    mae = float(np.abs(x - y).mean())
    spread = float(np.subtract(*np.quantile(b, [0.99, 0.01])))
    x, y = x - x.mean(), y - y.mean()
    size = math.sqrt(float((x * x).sum() * (y * y).sum()))
    return mae, mae / spread if spread > 0 else math.nan, float((x * y).sum()) / size if size > 1e-12 else math.nan


def quality_loop(frames: list[np.ndarray], reference: np.ndarray, every: int = 8, decay: float = 0.7, **options) -> list[dict]:
    """Frames in order: which elements are reliable and agree, the motion from a decayed start, and the metrics of the
    straightened frame; every so many frames the reference becomes the mean of itself and the frames since."""
    from .structure import difference_mask

    out, start, since = [], None, []
    for i, frame in enumerate(frames):
        mask, _, trust = difference_mask(reference, frame)
        motion = flow(frame, reference, start=start, **options)
        straight = warp(np.asarray(frame, float), motion.field)
        start = decay * motion.field
        mae, relative, ncc = frame_metrics(straight, reference, mask)
        out.append({"error_before": motion.before, "error_after": motion.after, "masked": float(mask.mean()), "reliability": float(trust.mean()), "mae": mae, "relative": relative, "ncc": ncc})
        since.append(straight)
        if (i + 1) % every == 0:
            reference, since = np.mean([reference, *since], axis=0), []
    return out
