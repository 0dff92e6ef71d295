"""Learners whose loss isn't a sum of squares of linear functions: hinge and epsilon-insensitive machines, one-class machines, networks.

All are fitted by one trainer. An evaluation is one pass over the rows that adds up loss and gradient, of several steps along a
direction at once; the state is as large as the parameters. Persist the rows: a fit takes some tens of passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import matrix_udf
from skein.functions.sums import added
from skein.operators.subspace import Moments, _label

#: (rows' features, rows' targets, parameters) to the sums of losses and of gradients.
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]
STEPS = (1.0, 0.5, 0.2, 0.05, 0.01, 3.0)


def minimise(rows: DataFrame, loss: Loss, start: np.ndarray, penalty: Callable[[np.ndarray], tuple[float, np.ndarray]], n: float, rounds: int = 60, tolerance: float = 1e-7, target: str | None = "y", memory: int = 12) -> np.ndarray:
    """Parameters of the least mean ``loss`` plus ``penalty``: limited-memory quasi-Newton directions, the best of STEPS on each."""
    slim = rows.select("features", *([F.col(target).alias("y")] if target else []))

    def evaluate(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        def one(batch: pd.DataFrame) -> dict[int, np.ndarray]:
            x = np.stack(batch["features"].to_numpy()).astype(float)
            y = (np.stack(batch["y"].to_numpy()) if batch["y"].dtype == object else batch["y"].to_numpy()).astype(float) if target else x
            return {k: np.concatenate([[f], g]) for k, p in enumerate(points) for f, g in [loss(x, y, p)]}

        sums = added(slim, one)
        out = []
        for k, p in enumerate(points):
            f, g = penalty(p)
            out.append((sums[k][0] / n + f, sums[k][1:] / n + g))
        return out

    x, past, reach = start.copy(), [], 1.0
    f, g = evaluate([x])[0]
    for _ in range(rounds):
        if np.abs(g).max() < tolerance:
            break
        d, gains = -g, []
        for s, y in reversed(past):
            gains.append((s @ d) / (y @ s))
            d = d - gains[-1] * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(past, reversed(gains), strict=True):
            d = d + s * (a - (y @ d) / (y @ s))
        if d @ g >= 0:
            d, past = -g, []
        steps = [reach * t for t in STEPS]
        found = evaluate([x + t * d for t in steps])
        k = min(range(len(steps)), key=lambda i: found[i][0] if np.isfinite(found[i][0]) else np.inf)
        if not found[k][0] < f:
            if not past:
                reach /= 100
                if reach < 1e-8:
                    break
            past = []
            continue
        step, reach = steps[k] * d, 1.0
        change = found[k][1] - g
        small = f - found[k][0] <= tolerance * max(1.0, abs(f))
        x, (f, g) = x + step, found[k]
        if step @ change > 1e-12 * np.linalg.norm(step) * np.linalg.norm(change):
            past = [*past, (step, change)][-memory:]
        if small:
            break
    return x


def hinge(margin: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, margin) with its corner rounded over ``width``, and its slope."""
    slope = np.clip(margin / width, 0, 1)
    return np.where(margin < width, slope * np.maximum(margin, 0) / 2, margin - width / 2), slope


#: The corner is rounded ever less, each fit starting from the one before.
WIDTHS = (0.3, 0.03, 0.003)


@dataclass
class Machines:
    """A linear machine for each two classes: weights, the last that of a constant 1."""

    classes: list
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def predict(self, features: Column) -> Column:
        """The class that wins most pairs, the first of ties."""

        def run(x: np.ndarray) -> np.ndarray:
            z = x @ self.weights[:, :-1].T + self.weights[:, -1]
            wins = np.zeros((len(x), len(self.classes)))
            for k, (a, b) in enumerate(self.pairs):
                wins[:, a] += z[:, k] > 0
                wins[:, b] += z[:, k] <= 0
            return wins.argmax(axis=1)[:, None].astype(float)

        return _label(F.get(matrix_udf(run)(features), F.lit(0)), self.classes)

    def importance(self) -> np.ndarray:
        """Summed absolute weight of each feature, as eliminations take it."""
        return np.abs(self.weights[:, :-1]).sum(axis=0)


def support_vectors(rows: DataFrame, box: float = 1000.0, rounds: int = 40, target: str = "target") -> Machines:
    """Machines of 1/2 |w|^2 + ``box`` times the summed hinge losses, all pairs in the same passes. The constant's weight counts in
    |w|^2. Rows without a class or features are left out; features should be standardised, or Fourier features of such."""
    held = rows.where(F.col(target).isNotNull() & F.col("features").isNotNull())
    counts = {r[0]: r[1] for r in held.groupBy(target).count().collect()}
    classes = sorted(counts)
    pairs = list(combinations(range(len(classes)), 2))
    dim = len(held.select("features").first()[0])
    coded = held.select("features", (F.array_position(F.lit(classes), F.col(target)) - 1).cast("double").alias("y"))
    n = float(sum(counts.values()))
    of = np.array([[1.0 if c == a else -1.0 if c == b else 0.0 for a, b in pairs] for c in range(len(classes))])
    w = np.zeros(len(pairs) * (dim + 1))
    for width in WIDTHS:

        def loss(x: np.ndarray, y: np.ndarray, p: np.ndarray, width: float = width) -> tuple[float, np.ndarray]:
            m, one = p.reshape(len(pairs), -1), np.column_stack([x, np.ones(len(x))])
            side = of[y.astype(int)]
            value, slope = hinge(np.where(side == 0, -1.0, 1 - side * (one @ m.T)), width)
            return float(value.sum()), (-(slope * side).T @ one).ravel()

        w = minimise(coded, loss, w, lambda p: (p @ p / (2 * box * n), p / (box * n)), n, rounds)
    return Machines(classes, pairs, w.reshape(len(pairs), -1))


@dataclass
class Line:
    weights: np.ndarray

    def predict(self, features: Column) -> Column:
        w = self.weights
        return F.get(matrix_udf(lambda x: (x @ w[:-1] + w[-1])[:, None])(features), F.lit(0))


def support_regression(rows: DataFrame, box: float = 1.0, insensitive: float = 0.1, rounds: int = 40, target: str = "y") -> Line:
    """1/2 |w|^2 + ``box`` times the summed max(0, |y - w x| - ``insensitive``)."""
    held = rows.where(F.col(target).isNotNull() & F.col("features").isNotNull())
    n, dim = float(held.count()), len(held.select("features").first()[0])
    w = np.zeros(dim + 1)
    for width in WIDTHS:

        def loss(x: np.ndarray, y: np.ndarray, p: np.ndarray, width: float = width) -> tuple[float, np.ndarray]:
            one = np.column_stack([x, np.ones(len(x))])
            off = y - one @ p
            value, slope = hinge(np.abs(off) - insensitive, width)
            return float(value.sum()), -(slope * np.sign(off)) @ one

        w = minimise(held, loss, w, lambda p: (p @ p / (2 * box * n), p / (box * n)), n, rounds, target=target)
    return Line(w)


@dataclass
class OneClassMachine:
    """Score w x - rho: below 0 is novel."""

    weights: np.ndarray
    rho: float
    higher_is_novel = False

    def score(self, features: Column) -> Column:
        w, rho = self.weights, self.rho
        return F.get(matrix_udf(lambda x: (x @ w - rho)[:, None])(features), F.lit(0))


def one_class_machine(rows: DataFrame, share: float = 0.05, rounds: int = 40) -> OneClassMachine:
    """1/2 |w|^2 - rho + the mean of max(0, rho - w x) / ``share``: about that share of the rows scores below 0."""
    held = rows.where(F.col("features").isNotNull())
    n, dim = float(held.count()), len(held.select("features").first()[0])
    p = np.zeros(dim + 1)
    for width in WIDTHS:

        def loss(x: np.ndarray, _: np.ndarray, p: np.ndarray, width: float = width) -> tuple[float, np.ndarray]:
            value, slope = hinge(p[-1] - x @ p[:-1], width * share)
            return float(value.sum()) / share, np.append(-(slope @ x), slope.sum()) / share

        def penalty(p: np.ndarray) -> tuple[float, np.ndarray]:
            return p[:-1] @ p[:-1] / 2 - p[-1], np.append(p[:-1], -1.0)

        p = minimise(held, loss, p, penalty, n, rounds, target=None)
    return OneClassMachine(p[:-1], float(p[-1]))


@dataclass
class Network:
    """Hidden layers of tanh units and a linear output, on standardised features and targets."""

    sizes: list[int]
    params: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    y_mean: np.ndarray
    y_scale: np.ndarray
    higher_is_novel = True

    def layers(self, p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in pairwise(self.sizes):
            out.append((p[at : at + a * b].reshape(a, b), p[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        """Activations of every layer for standardised ``x``."""
        out = [x]
        layers = self.layers(p)
        for k, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(z if k == len(layers) - 1 else np.tanh(z))
        return out

    def loss(self, x: np.ndarray, y: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the summed squared errors and their gradient, by back-propagation."""
        a = self.forward((x - self.mean) / self.scale, p)
        off = a[-1] - (y.reshape(len(x), -1) - self.y_mean) / self.y_scale
        delta, parts = off, []
        for k, (w, _) in reversed(list(enumerate(self.layers(p)))):
            parts += [delta.sum(axis=0), (a[k].T @ delta).ravel()]
            if k:
                delta = (delta @ w.T) * (1 - a[k] ** 2)
        return float((off * off).sum() / 2), np.concatenate(parts[::-1])

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, self.params)[-1] * self.y_scale + self.y_mean

    def predict(self, features: Column) -> Column:
        return F.get(matrix_udf(self.output)(features), F.lit(0))

    def score(self, features: Column) -> Column:
        """Of an auto-encoder: the root of a row's summed squared reconstruction errors, high for novel rows."""
        return F.get(matrix_udf(lambda x: np.sqrt(((self.output(x) - x) ** 2).sum(axis=1, keepdims=True)))(features), F.lit(0))


def _deviations(m: Moments) -> np.ndarray:
    dev = np.sqrt(np.maximum(np.diag(m.scatter) / max(m.n - 1, 1), 0))
    return np.where(dev > 0, dev, 1.0)


def network(rows: DataFrame, m: Moments, hidden: tuple[int, ...] = (10,), target: str | None = "y", rounds: int = 80, decay: float = 1e-4, seed: int = 1) -> Network:
    """A network trained on all rows. ``m``: their statistics, with the target last. Without a target it is an auto-encoder of the features."""
    dim = len(m.mean) - (target is not None)
    mean, dev = m.mean, _deviations(m)
    sizes = [dim, *hidden, dim if target is None else 1]
    rng = np.random.default_rng(seed)
    start = np.concatenate([np.concatenate([rng.normal(0, 1 / np.sqrt(a), a * b), rng.normal(0, 0.5, b)]) for a, b in pairwise(sizes)])
    own = Network(sizes, start, mean[:dim], dev[:dim], *((mean, dev) if target is None else (mean[-1:], dev[-1:])))
    held = rows.where(F.col("features").isNotNull() & (F.col(target).isNotNull() if target else F.lit(True)))
    own.params = minimise(held, own.loss, start, lambda p: (decay / 2 * (p @ p), decay * p), m.n, rounds, target=target)
    return own


def auto_encoder_threshold(rows: DataFrame, model: Network) -> float:
    """Twice the mean score of the training rows."""
    return 2 * rows.select(model.score(F.col("features")).alias("s")).agg(F.avg("s")).first()[0]
