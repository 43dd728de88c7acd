"""Sparse, compact motion modes of a vector field: shared activations times vector responses of patches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Modes:
    """Activations h (k, t) of unit norm, responses b (k, n, 2), their support, the explained part, and the objective by round."""

    h: np.ndarray
    b: np.ndarray
    support: np.ndarray
    explained: float
    objective: list[float] = field(default_factory=list)


def energy_rank(y: np.ndarray, target: float = 0.85, most: int = 4) -> tuple[int, list[float]]:
    """The least rank whose share of the squared singular values reaches the target, clamped; and the shares by rank."""
    s = np.linalg.svd(y.reshape(len(y), -1), compute_uv=False) ** 2
    if not s.sum():
        return 1, [1.0]
    share = np.cumsum(s) / s.sum()
    return int(np.clip(np.searchsorted(share, target - 1e-12) + 1, 1, min(most, len(s)))), share.tolist()


def seeds(y: np.ndarray, coords: np.ndarray, k: int, apart: float) -> list[int]:
    """Patches by energy, each at least so far from the ones before; then the strongest of the rest, whatever their place."""
    order = np.argsort(-(y**2).sum((0, 2)), kind="stable").tolist()
    out: list[int] = []
    for i in order:
        if len(out) < k and all(np.hypot(*(coords[i] - coords[j])) >= apart for j in out):
            out.append(i)
    return out + [i for i in order if i not in out][: k - len(out)]


def _trace(path: np.ndarray) -> np.ndarray:
    """A patch's path (t, 2) as one trace of unit norm: along its mean direction, or its length where there is none."""
    mean = path.mean(0)
    size = np.hypot(*mean)
    h = path @ (mean / size) if size > 1e-12 else np.hypot(path[:, 0], path[:, 1])
    norm = np.linalg.norm(h)
    return h / norm if norm > 1e-12 else np.full(len(h), 1 / np.sqrt(len(h)))


def centres(b: np.ndarray, coords: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each mode's centre of amplitude; a mode without any keeps its centre."""
    a = np.hypot(b[..., 0], b[..., 1])
    total = a.sum(1, keepdims=True)
    return np.where(total > 1e-12, a @ coords / np.maximum(total, 1e-12), before)


def fit_modes(y: np.ndarray, coords: np.ndarray, most: int = 4, weight: float = 0.05, rho: float = 1.0, kappa: float = 4.0, rounds: int = 200, tolerance: float = 1e-4, target: float = 0.85, keep: float = 0.08, apart: float = 3.0, ridge: float = 1e-6) -> Modes:
    """Modes of y (t, n, 2) whose patches lie at coords (n, 2).

    The objective is the residual's share of the energy plus weight times the mean amplitude of the responses, each
    patch's weighed by rho + kappa times its squared distance from its mode's centre (coordinates scaled to 0..1,
    amplitudes to their mean at the start). A round takes proximal steps in the responses, whose step size is halved
    until the objective falls, and a least-squares step in the activations, halved likewise; it stops when a round
    gains less than tolerance. Patches below ``keep`` of their mode's largest response are then cut off."""
    t, n, _ = y.shape
    k, _ = energy_rank(y, target, most)
    k = min(k, n)
    low, high = coords.min(0), coords.max(0)
    places = (coords - low) / np.maximum(high - low, 1e-12)
    flat = y.reshape(t, -1)
    energy = max(float((flat**2).sum()), 1e-300)
    h = np.stack([_trace(y[:, i]) for i in seeds(y, coords, k, apart)])
    b = np.linalg.solve(h @ h.T + ridge * np.eye(k), h @ flat).reshape(k, n, 2)
    scale = max(float(np.hypot(b[..., 0], b[..., 1]).mean()), 1e-12)
    middle = centres(b, places, places[seeds(y, coords, k, apart)])

    def far(middle: np.ndarray) -> np.ndarray:
        return weight * (rho + kappa * ((places[None] - middle[:, None]) ** 2).sum(2)) / (n * k * scale)

    def value(h: np.ndarray, b: np.ndarray, middle: np.ndarray) -> float:
        return float(((flat - h.T @ b.reshape(k, -1)) ** 2).sum()) / energy + float((far(middle) * np.hypot(b[..., 0], b[..., 1])).sum())

    now = value(h, b, middle)
    out = [now]
    for _ in range(rounds):
        begin = now
        cost = far(middle)
        step = energy / (2 * max(float(np.linalg.norm(h @ h.T, 2)), 1e-12))
        for _ in range(5):
            slope = -2 * (h @ (flat - h.T @ b.reshape(k, -1))).reshape(k, n, 2) / energy
            for _ in range(30):
                c = b - step * slope
                size = np.hypot(c[..., 0], c[..., 1])
                c = c * np.maximum(0, 1 - step * cost / np.maximum(size, 1e-300))[..., None]
                then = value(h, c, middle)
                if then <= now:
                    b, now = c, then
                    break
                step /= 2
        g = b.reshape(k, -1)
        best = np.linalg.solve(g @ g.T + ridge * np.eye(k), g @ flat.T)
        for part in 0.5 ** np.arange(8):
            q = h + part * (best - h)
            norm = np.maximum(np.linalg.norm(q, axis=1), 1e-12)
            then = value(q / norm[:, None], b * norm[:, None, None], middle)
            if then <= now:
                h, b, now = q / norm[:, None], b * norm[:, None, None], then
                break
        moved = centres(b, places, middle)
        if value(h, b, moved) <= now:
            middle, now = moved, value(h, b, moved)
        out.append(now)
        if begin - now < tolerance * max(begin, 1e-12):
            break
    size = np.hypot(b[..., 0], b[..., 1])
    top = size.max(1, keepdims=True)
    support = (size > keep * top) & (top > 1e-12)
    b = b * support[..., None]
    return Modes(h, b, support, 1 - float(((flat - h.T @ b.reshape(k, -1)) ** 2).sum()) / energy, out)


def contributions(y: np.ndarray, m: Modes) -> np.ndarray:
    """How much more of the energy is unexplained without each mode."""
    flat = y.reshape(len(y), -1)
    parts = [np.outer(h, b.ravel()) for h, b in zip(m.h, m.b, strict=True)]
    rest = flat - sum(parts)
    return np.array([float(((rest + p) ** 2).sum() - (rest**2).sum()) for p in parts]) / max(float((flat**2).sum()), 1e-300)
