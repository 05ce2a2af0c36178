"""NumPy kernels of the many small fits: elastic nets on the weighted mean loss, and negative-binomial tests.

Objective of the elastic nets: sum(w * loss) / sum(w) + strength * (ratio * |b|_1 + (1 - ratio) / 2 * |b|^2), intercept free.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Fit:
    coef: np.ndarray  # classes (1 for binary and continuous) x features
    intercept: np.ndarray
    converged: bool

    def predict(self, x: np.ndarray, kind: str) -> np.ndarray:
        s = x @ self.coef.T + self.intercept
        if kind == "continuous":
            return s[:, 0]
        if kind == "binary":
            p = 1 / (1 + np.exp(-np.clip(s[:, 0], -500, 500)))
            return np.column_stack([1 - p, p])
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def contrasts(self, kind: str) -> np.ndarray:
        """One row a contrast: class k against class 0, or the response."""
        return self.coef[1:] - self.coef[0] if kind == "multiclass" else self.coef


def _shrink(b: np.ndarray, t: float) -> np.ndarray:
    return np.sign(b) * np.maximum(np.abs(b) - t, 0)


def elastic_net(x, y, w, kind: str, strength: float, ratio: float, tol: float = 1e-7, max_iter: int = 10_000, start: Fit | None = None) -> Fit:
    """Accelerated proximal gradient with restarts; convex, so the result does not depend on the start."""
    n, p = x.shape
    w = np.asarray(w, float) / np.sum(w)
    k = int(y.max()) + 1 if kind == "multiclass" else 1
    hot = np.eye(k)[y.astype(int)] if kind == "multiclass" else np.asarray(y, float)[:, None]
    a = np.column_stack([x, np.ones(n)])
    bound = {"continuous": 1.0, "binary": 0.25, "multiclass": 0.5}[kind]
    size = np.linalg.norm(np.sqrt(w)[:, None] * a, 2) ** 2 * bound + strength * (1 - ratio)
    b = np.zeros((k, p + 1)) if start is None else np.column_stack([start.coef, start.intercept])

    def slope(b):
        s = a @ b.T
        if kind == "continuous":
            q = s
        elif kind == "binary":
            q = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        else:
            e = np.exp(s - s.max(axis=1, keepdims=True))
            q = e / e.sum(axis=1, keepdims=True)
        g = (w[:, None] * (q - hot)).T @ a
        g[:, :p] += strength * (1 - ratio) * b[:, :p]
        return g

    z, t, done = b, 1.0, False
    for _ in range(max_iter):
        new = z - slope(z) / size
        new[:, :p] = _shrink(new[:, :p], strength * ratio / size)
        if np.sum((z - new) * (new - b)) > 0:
            t = 1.0
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / nxt * (new - b)
        move = np.abs(new - b).max()
        b, t = new, nxt
        if move <= tol * max(1.0, np.abs(b).max()) / math.sqrt(max(1.0, size)):
            done = True
            break
    return Fit(b[:, :p], b[:, p], done)


def dummy(y, w, kind: str, k: int) -> Fit:
    """No predictors: the weighted mean, or the weighted class shares."""
    w = np.asarray(w, float) / np.sum(w)
    if kind == "continuous":
        return Fit(np.zeros((1, 0)), np.array([float(w @ y)]), True)
    share = np.clip(np.bincount(y.astype(int), weights=w, minlength=k), 1e-12, None)
    return Fit(np.zeros((1, 0)), np.array([math.log(share[1] / share[0])]), True) if kind == "binary" else Fit(np.zeros((k, 0)), np.log(share), True)


def mean_loss(y, pred, w, kind: str) -> float:
    w = np.asarray(w, float) / np.sum(w)
    if kind == "continuous":
        return float(w @ (y - pred) ** 2)
    eps = np.finfo(float).eps
    return float(-(w @ np.log(np.clip(pred[np.arange(len(y)), y.astype(int)], eps, 1))))


def group_weights(groups: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(groups, return_inverse=True, return_counts=True)
    w = 1 / n[at]
    return w / w.mean()


def size_factors(counts: np.ndarray) -> np.ndarray:
    """samples x genes -> factors: medians of ratios to geometric means over positive counts."""
    logs = np.where(counts > 0, np.log(np.maximum(counts, 1e-300)), 0.0)
    center = logs.sum(axis=0) / len(counts)
    use = (counts > 0).any(axis=0)
    out = np.array([np.exp(np.median((logs[i] - center)[use & (counts[i] > 0)])) for i in range(len(counts))])
    return out / np.exp(np.mean(np.log(out)))


def nb_loglik(y, mu, alpha):
    r = 1 / alpha
    lg = np.vectorize(math.lgamma)
    return float((lg(y + r) - math.lgamma(r) - lg(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum())


def nb_fit(y, design, offset, alpha, ridge=1e-6, steps=50):
    """Coefficients, covariance and means of a negative-binomial log-linear model at a fixed dispersion."""
    beta = np.zeros(design.shape[1])
    beta[0] = math.log(max(float(np.mean(y / np.exp(offset))), 1e-8))
    cov = np.eye(len(beta))
    for _ in range(steps):
        mu = np.maximum(np.exp(np.clip(design @ beta + offset, -30, 30)), 1e-8)
        weight = mu / (1 + alpha * mu)
        info = design.T @ (weight[:, None] * design) + ridge * np.eye(len(beta))
        cov = np.linalg.inv(info)
        new = cov @ (design.T @ (weight * (design @ beta + (y - mu) / mu)))
        if np.abs(new - beta).max() < 1e-8:
            beta = new
            break
        beta = np.clip(new, -30, 30)
    return beta, cov, np.maximum(np.exp(np.clip(design @ beta + offset, -30, 30)), 1e-8)


def nb_dispersion(y, design, offset, prior=None, low=1e-8, high=10.0):
    """Dispersion by profile likelihood with the Cox-Reid term (golden section on its logarithm); prior: (log mean, log
    variance) of a normal prior on the logarithm."""
    def value(log_a):
        alpha = math.exp(log_a)
        _, _, mu = nb_fit(y, design, offset, alpha, steps=15)
        weight = mu / (1 + alpha * mu)
        _, logdet = np.linalg.slogdet(design.T @ (weight[:, None] * design) + 1e-9 * np.eye(design.shape[1]))
        out = nb_loglik(y, mu, alpha) - logdet / 2
        return out - (log_a - prior[0]) ** 2 / (2 * prior[1]) if prior else out

    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = value(c), value(d)
    for _ in range(24):
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = value(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = value(d)
    return math.exp((a + b) / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
