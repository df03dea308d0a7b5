"""Logistic regression over hashed sparse features in numpy, and its calibration."""

from __future__ import annotations

import numpy as np

_PART = 1 << 20


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(index: np.ndarray, value: np.ndarray, offs: np.ndarray, y: np.ndarray, dim: int, l2: float, rounds: int = 80, rate: float = 0.3, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on rows given as (index, value) with offsets; rows may be empty.

    Items are gone through in ranges of ``_PART``, so that what a round needs beside the table is small.
    """
    index, value = index.astype(np.int32, copy=False), value.astype(np.float32, copy=False)
    cuts = [0]
    while cuts[-1] < len(y):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offs, offs[cuts[-1]] + _PART, "right")) - 1))
    w, b = np.zeros(dim), 0.0
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    share = np.ones(len(y)) if weight is None else weight
    share = share / share.sum()
    for k in range(1, rounds + 1):
        gw, gb = l2 * w, 0.0
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at, x = index[offs[i] : offs[j]], value[offs[i] : offs[j]]
            row = np.repeat(np.arange(j - i), np.diff(offs[i : j + 1]))
            z = np.bincount(row, x * w[at], j - i) + b
            g = (sigmoid(z) - y[i:j]) * share[i:j]
            gw += np.bincount(at, x * g[row], dim)
            gb += g.sum()
        m *= 0.9
        m += 0.1 * gw
        v *= 0.99
        gw *= gw
        v += 0.01 * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 + 3 * k / rounds)
        w -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        b -= step * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    return w, float(b)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a probability, by Newton's method with smoothed targets."""
    share = np.ones(len(y)) if weight is None else weight
    pos, neg = (share * y).sum(), (share * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    loss = lambda a, b: (share * (np.logaddexp(0, a * z + b) - t * (a * z + b))).sum() + 5e-4 * (a - 1) ** 2
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        g, h = share * (p - t), share * p * (1 - p) + 1e-9
        grad = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step = np.array([np.clip(step[0], -1, 1), np.clip(step[1], -2, 2)])
        for _ in range(20):  # where margins lie far out, a whole step can overshoot, there and back for ever
            if loss(a - step[0], b - step[1]) <= loss(a, b):
                a, b = a - float(step[0]), b - float(step[1])
                break
            step /= 2
    return max(a, 1e-3), b
