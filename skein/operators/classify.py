"""Pairwise linear machines from class statistics: least-squares support vectors, recursive elimination."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column

from skein.functions.layout import matrix_udf
from skein.operators.regress import Linear, ridge
from skein.operators.subspace import Moments, _label


def pairwise(by_class: dict[tuple, Moments], strength: float = 1e-3) -> dict[tuple[int, int], Linear]:
    """For each two classes a least-squares machine with targets +1 and -1: no pass over the rows beyond their statistics."""
    names = sorted(by_class)
    return {(a, b): ridge(by_class[names[a]].with_constant(1.0) + by_class[names[b]].with_constant(-1.0), strength) for a, b in combinations(range(len(names)), 2)}


def vote(machines: dict[tuple[int, int], Linear], classes: list, features: Column) -> Column:
    """The class that wins most pairs, the first of ties."""
    pairs = list(machines)
    beta, bias = np.stack([machines[p].beta for p in pairs]).T, np.array([machines[p].intercept for p in pairs])

    def run(x: np.ndarray) -> np.ndarray:
        wins = np.zeros((len(x), len(classes)))
        z = x @ beta + bias
        for k, (a, b) in enumerate(pairs):
            wins[:, a] += z[:, k] > 0
            wins[:, b] += z[:, k] <= 0
        return wins.argmax(axis=1)[:, None].astype(float)

    from pyspark.sql import functions as F

    return _label(F.get(matrix_udf(run)(features), F.lit(0)), classes)


def recursive_elimination(by_class: dict[tuple, Moments], step: int = 1) -> list[int]:
    """Features (from 0), best first: those with the least summed pairwise weight leave, ``step`` at a time; the survivor leads. Constant features are last."""
    total = sum(list(by_class.values())[1:], list(by_class.values())[0])
    dev = np.sqrt(np.maximum(np.diag(total.scatter) / (total.n - 1), 0))
    own = {c: m.scaled(total.mean, np.where(dev > 0, 1 / np.where(dev > 0, dev, 1), 0)) for c, m in by_class.items()}
    left, out = [k for k in range(len(dev)) if dev[k] > 0], [k for k in range(len(dev)) if not dev[k] > 0]
    while len(left) > 1:
        weight = sum(np.abs(x.beta) for x in pairwise({c: m.of(left) for c, m in own.items()}).values())
        for k in sorted(np.argsort(weight, kind="stable")[: min(step, len(left) - 1)], reverse=True):
            out.insert(0, left[k])
            del left[k]
    return left + out
