"""Regression on one-pass statistics: partial least squares, and kernel ridge on random Fourier features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.layout import matrix_udf
from skein.operators.subspace import Moments


@dataclass
class Linear:
    intercept: float
    beta: np.ndarray

    def predict(self, features: Column) -> Column:
        beta, b = self.beta, self.intercept
        return F.get(matrix_udf(lambda x: (x @ beta + b)[:, None])(features), F.lit(0))

    def uncertainty(self, u: Column) -> Column:
        beta = self.beta**2
        return F.get(matrix_udf(lambda x: np.sqrt((x * x) @ beta)[:, None])(u), F.lit(0))


def pls(m: Moments, components: int = 5) -> Linear:
    """SIMPLS from the statistics of [1, x, y], y last: weights follow the covariance with y, loadings are made orthogonal."""
    xx, xy = m.scatter[:-1, :-1], m.scatter[:-1, -1]
    beta, basis, s = np.zeros(len(xy)), [], xy.copy()
    for _ in range(min(components, len(xy))):
        norm = float(np.sqrt(max(s @ xx @ s, 0.0)))
        if norm <= 1e-12 * max(1.0, float(np.sqrt(np.trace(xx)))):
            break
        r = s / norm
        p = xx @ r
        beta += r * (r @ xy)
        v = p.copy()
        for _ in range(2):
            for b in basis:
                v -= b * (b @ v)
        size = np.linalg.norm(v)
        if size <= 1e-14 * np.linalg.norm(p):
            break
        v /= size
        basis.append(v)
        s = s - v * (v @ s)
    return Linear(float(m.mean[-1] - m.mean[:-1] @ beta), beta)


def ridge(m: Moments, strength: float = 1e-3) -> Linear:
    xx = m.scatter[:-1, :-1]
    beta = np.linalg.solve(xx + strength * (np.trace(xx) / len(xx) + 1e-12) * np.eye(len(xx)), m.scatter[:-1, -1])
    return Linear(float(m.mean[-1] - m.mean[:-1] @ beta), beta)


@dataclass
class FourierFeatures:
    """Random Fourier features of an RBF kernel on standardised inputs: an approximation whose size doesn't grow with the rows."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def of(cls, m: Moments, size: int = 128, gamma: float | None = None, seed: int = 3) -> FourierFeatures:
        d = len(m.mean)
        dev = np.sqrt(np.diag(m.scatter) / (m.n - 1))
        rng = np.random.default_rng(seed)
        return cls(m.mean, np.where(dev > 0, dev, np.inf), rng.normal(0, np.sqrt(2 * (gamma or 1 / d)), (d, size)), rng.uniform(0, 2 * np.pi, size))

    def __call__(self, features: Column) -> Column:
        size = np.sqrt(2 / len(self.b))
        return matrix_udf(lambda x: size * np.cos((x - self.mean) / self.scale @ self.w + self.b))(features)


@dataclass
class SmallNetwork:
    """One hidden layer of random tanh units with a ridge output: a network with a fixed budget and seed."""

    hidden: FourierFeatures

    def __call__(self, features: Column) -> Column:
        h = self.hidden
        return matrix_udf(lambda x: np.tanh((x - h.mean) / h.scale @ h.w + h.b - np.pi))(features)
