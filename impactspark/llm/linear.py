"""Logistic regression on bounded samples, in numpy on the driver; the models are small arrays sent to the workers."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over the whole sample; the same input gives the same model."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    s = np.ones(n) if weight is None else weight
    s = s / s.sum()
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        r = (sigmoid(x @ w + b) - y) * s
        g = np.append(x.T @ r + l2 * w, r.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9) * (1 - 0.9 * t / steps)
        w -= step[:d]
        b -= step[d]
    return w, float(b)


def fit_sparse(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, d: int, y: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """As fit_dense, for a matrix given by its entries."""
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, vals * w[cols], n) + b
        r = (sigmoid(z) - y) / n
        g = np.append(np.bincount(cols, vals * r[rows], d) + l2 * w, r.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9) * (1 - 0.9 * t / steps)
        w -= step[:d]
        b -= step[d]
    return w, float(b)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that calibrate the logits z, with smoothed targets so that a clean split stays finite."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.abs(z).mean()) or 1.0
    w, b = fit_dense((z / scale)[:, None], target, l2=1e-6, steps=400)
    return float(w[0]) / scale, b


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    rank = np.empty(len(s))
    _, start, count = np.unique(s, return_index=True, return_counts=True)
    rank[order] = np.repeat(start + (count + 1) / 2, count)
    pos = int(y.sum())
    return float((rank[y > 0].sum() - pos * (pos + 1) / 2) / max(1, pos * (len(y) - pos)))
