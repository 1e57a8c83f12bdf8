"""Hashed character n-grams and a logistic regression in numpy, shared by the text and URL classifiers."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def ngram_ids(text: str, sizes: tuple[int, ...], bits: int, seed: int = 0) -> np.ndarray:
    """Hashes below 2**bits of the character n-grams of the whole ``text``, one for each distinct hash, unordered."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    values = (codes.astype(np.uint64) + np.uint64(1 + seed)) * _MULTIPLIER
    found, state = [], np.zeros(len(values), dtype=np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(values) < n:
            break
        state = state[: len(values) - n + 1] * _BASE + values[n - 1 :]
        if n in sizes:
            mixed = state ^ (state >> np.uint64(29))
            found.append(((mixed * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int32))
    if not found:
        return np.empty(0, dtype=np.int32)
    ids = np.concatenate(found)
    last = np.empty(1 << bits, dtype=np.int32)
    order = np.arange(len(ids), dtype=np.int32)
    last[ids] = order  # the last place of each hash; places that are no last place repeat a hash
    return ids[last[ids] == order]


def minimise(f, start: np.ndarray, rounds: int = 80, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking; ``f`` returns a value and its gradient."""
    x = start.copy()
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.linalg.norm(grad) <= tolerance * max(1.0, np.linalg.norm(x)):
            break
        way, alphas = grad.copy(), []
        for s, y, rho in reversed(steps):
            alphas.append(rho * s.dot(way))
            way -= alphas[-1] * y
        if steps:
            s, y, _ = steps[-1]
            way *= s.dot(y) / y.dot(y)
        for (s, y, rho), a in zip(steps, reversed(alphas), strict=True):
            way += s * (a - rho * y.dot(way))
        slope, size = -grad.dot(way), 1.0 if steps else 1.0 / max(1.0, np.linalg.norm(grad))
        while size > 1e-10:
            new = x - size * way
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if s.dot(y) > 1e-12:
            steps = [*steps, (s, y, 1.0 / s.dot(y))][-memory:]
        x, value, grad = new, new_value, new_grad
    return x


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept for rows of feature ids; feature j has the value ``scale[j]`` where present."""
    used = np.flatnonzero(scale)  # a feature without a value has no weight
    place = np.full(len(scale), -1, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    rows = [x[x >= 0] for x in (place[r] for r in rows)]
    kept = scale[used]
    y = np.asarray(labels, dtype=np.float64)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled = kept * w[:-1]
        margin = np.array([scaled[r].sum() for r in rows]) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
        value = (np.logaddexp(0, margin) - y * margin).sum() + l2 / 2 * w[:-1].dot(w[:-1])
        grad = np.zeros(len(used))
        for r, e in zip(rows, error, strict=True):
            grad[r] += e  # a row has no feature twice
        return value, np.append(grad * kept + l2 * w[:-1], error.sum())

    w = minimise(loss, np.zeros(len(used) + 1))
    out = np.zeros(len(scale))
    out[used] = w[:-1] * kept
    return out, float(w[-1])


def sigmoid(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))
