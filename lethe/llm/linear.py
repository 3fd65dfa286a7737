"""Linear models on indicator features, fitted on bounded samples on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Features are hashed into so many columns.
DIM = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def columns_of(hashes: np.ndarray) -> np.ndarray:
    """Distinct feature columns of 64-bit hashes, ascending."""
    return np.unique((hashes >> np.uint64(44)).astype(np.int32))


def log_count_ratios(rows: Sequence[np.ndarray], positive: np.ndarray, least: int = 3, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each indicator among positive rows over that among the others; 0 for those in under ``least`` rows."""
    p, q = np.zeros(DIM), np.zeros(DIM)
    for row, pos in zip(rows, positive):
        (p if pos else q)[row] += 1
    n, m = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    ratio = np.log((p + alpha) / (n + 2 * alpha)) - np.log((q + alpha) / (m + 2 * alpha))
    return np.where(p + q >= least, ratio, 0.0).astype(np.float32)


def scaled(row: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of one row, scaled and of length 1; columns of scale 0 are left out."""
    v = scale[row]
    on = v != 0
    row, v = row[on], v[on]
    norm = np.sqrt((v.astype(np.float64) ** 2).sum())
    return row, (v / norm).astype(np.float32) if norm else v


def dual_descent(rows: Sequence[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, extra: np.ndarray, cost: float = 1.0,
                 epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a linear model with hinge loss, by dual coordinate descent.

    extra: dense features of every row, the constant 1 among them. Either class
    weighs the same in sum. Returns weights by column, and of the dense features.
    """
    n = len(rows)
    w, u = np.zeros(DIM), np.zeros(extra.shape[1])
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, n / (2 * max(1, positive.sum())), n / (2 * max(1, (~positive).sum())))
    upper, alpha = cost * share, np.zeros(n)
    square = np.array([(v * v).sum() for _, v in rows]) + (extra * extra).sum(axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            if square[i] == 0:
                continue
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + u @ extra[i]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), upper[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[idx] += step * y[i] * v
                u += step * y[i] * extra[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, u


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def calibrate(margins: np.ndarray, positive: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve that turns margins into probabilities (Newton's method, smoothed targets)."""
    p, n = int(positive.sum()), int((~positive).sum())
    t = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, float(np.log((p + 1) / (n + 1)))
    for _ in range(steps):
        s = sigmoid(a * margins + b)
        d, h = s - t, np.maximum(s * (1 - s), 1e-9)
        g = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        size = max(1.0, float(np.abs(step).max()) / 5)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-6)), float(b)
