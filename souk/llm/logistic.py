"""Logistic regression on a small feature table: the last step of two classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None, ridge: float = 1e-3,
        steps: int = 50) -> Logistic:
    """Newton's method with a ridge; one class only or no rows gives a constant."""
    width = x.shape[1]
    w = np.ones(len(y)) if sample_weight is None else sample_weight
    total, ones = w.sum(), float((w * y).sum())
    share = (ones + 0.5) / (total + 2.0)  # no rows at all: the unlikely side
    constant = Logistic(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(share / (1 - share))))
    if not 0 < ones < total:
        return constant
    mean = (w @ x) / total
    scale = np.sqrt((w @ (x - mean) ** 2) / total)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(y), 1))])
    beta = np.zeros(width + 1)
    beta[-1] = constant.bias
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 0.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -40, 40)))
        gradient = z.T @ (w * (p - y)) / total + penalty * beta
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z / total + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, beta[:-1], float(beta[-1]))
