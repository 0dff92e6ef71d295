"""Feature counts, algorithm choice and Bayesian search, on statistics of folds.

All folds and all prefixes of a ranking come from one pass: a fold's training statistics are the total less the
fold's own, and a prefix's are a sub-matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.sums import added
from skein.operators import regress, subspace
from skein.operators.subspace import Moments, moments


def total(parts: list[Moments]) -> Moments:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def regression_losses(
    packed: DataFrame | None, rank: list[int], most: int = 100, components: int = 5, target: str = "y", fold: str = "fold", parts: dict[tuple, Moments] | None = None
) -> list[tuple[int, float]]:
    """(features, cross-validated RMSE) of PLS on each prefix of a ranking (features from 0). Held-out errors follow from the fold's own statistics; ``parts`` are these where they are at hand."""
    by_fold = parts or moments(packed, (fold,), also=(target,))
    whole = total(list(by_fold.values()))
    last = len(whole.mean) - 1
    out = []
    for n in range(1, min(most, len(rank)) + 1):
        at = [*rank[:n], last]
        sse = 0.0
        for own in by_fold.values():
            model = regress.pls((whole - own).of(at), components)
            sse += own.of(at).squares(model.intercept, model.beta)
        out.append((n, float(np.sqrt(max(sse, 0) / whole.n))))
    return out


def classification_losses(
    packed: DataFrame, rank: list[int], most: int = 100, metric: str = "mahalanobis", target: str = "target", fold: str = "fold", sizes: list[int] | None = None, parts: dict[tuple, Moments] | None = None
) -> list[tuple[int, float]]:
    """(features, cross-validated error in percent) of LDA on each prefix, or those of ``sizes``: one pass for the statistics (none where ``parts`` has them), one that counts the errors of all models."""
    return prefix_losses(packed, {"": (rank, metric)}, most, target, fold, sizes, parts)[""]


def prefix_losses(
    packed: DataFrame, ranks: dict[str, tuple[list[int], str]], most: int = 100, target: str = "target", fold: str = "fold", sizes: list[int] | None = None, parts: dict[tuple, Moments] | None = None
) -> dict[str, list[tuple[int, float]]]:
    """``classification_losses`` of several rankings, each with its metric: all of their models count errors in one pass."""
    parts = parts or moments(packed.where(F.col(target).isNotNull()), (fold, target))
    folds, classes = sorted({k[0] for k in parts}), sorted({k[1] for k in parts})
    jobs = [(name, n) for name, (rank, _) in ranks.items() for n in (sizes or range(1, min(most, len(rank)) + 1))]
    models = {}
    for f in folds:
        by_class = {(c,): total([m for k, m in parts.items() if k[0] != f and k[1] == c]) for c in classes if any(k[0] != f and k[1] == c for k in parts)}
        models[f] = [(ranks[name][0][:n], subspace.lda({c: m.of(ranks[name][0][:n]) for c, m in by_class.items()}, ranks[name][1])) for name, n in jobs]
    found = errors(packed, models, classes, target, fold)
    return {name: [(n, found[k]) for k, (own, n) in enumerate(jobs) if own == name] for name in ranks}


def errors(packed: DataFrame, models: dict, classes: list, target: str = "target", fold: str = "fold") -> list[float]:
    """Percent of rows that each of a fold's models (places of features, discriminant) gets wrong, over all folds. Tasks count; no row leaves them."""
    many = len(next(iter(models.values())))

    def one(batch: pd.DataFrame) -> dict[int, np.ndarray]:
        x = np.stack(batch["x"].to_numpy()).astype(float)
        out = np.zeros(many + 1)
        out[many] = len(x)
        for f in models:
            own = np.flatnonzero(x[:, 0] == f)
            for k, (at, model) in enumerate(models[f]) if len(own) else []:
                best = model.distances(x[np.ix_(own, [a + 2 for a in at])]).argmin(axis=1)
                out[k] += (np.array([classes.index(c) for c in model.classes])[best] != x[own, 1]).sum()
        return {0: out}

    index = F.array_position(F.lit(classes), F.col(target)) - 1
    rows = packed.select(F.concat(F.array(F.col(fold).cast("double"), index.cast("double")), "features").alias("x"))
    found = added(rows.where(F.col("x").isNotNull()), one)
    return (100 * (found[0][:many] / found[0][many])).tolist() if found else []


def best(losses: list[tuple]) -> tuple:
    """The first of the least losses."""
    return min(losses, key=lambda x: x[-1])


def out_of_fold(packed: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], Column]], fold: str = "fold") -> DataFrame:
    """``packed`` with ``prediction`` of the model that was fitted on the other folds."""
    out = None
    for f in sorted(r[0] for r in packed.select(fold).distinct().collect()):
        predict = fit(packed.where(F.col(fold) != f))
        own = packed.where(F.col(fold) == f)
        part = own.withColumn("prediction", predict(own))
        out = part if out is None else out.union(part)
    return out


def leaderboard(candidates: dict[str, Callable[[], float]]) -> list[tuple[str, float]]:
    """(name, loss) of each candidate in order of loss; all are evaluated on the caller's shared folds."""
    return sorted(((n, float(f())) for n, f in candidates.items()), key=lambda x: (x[1], x[0]))


def bayesian(objective: Callable[[int], float], low: int, high: int, rounds: int = 12, seed: int = 11) -> tuple[int, list[tuple[int, float]]]:
    """Minimises over whole numbers: a Gaussian process with expected improvement proposes, ``objective`` (a Spark job) answers."""
    rng = np.random.default_rng(seed)
    grid = np.arange(low, high + 1)
    seen: dict[int, float] = {}
    for x in dict.fromkeys([low, high, *rng.choice(grid, min(3, len(grid)), replace=False).tolist()]):
        seen[int(x)] = objective(int(x))
    unit = max(high - low, 1)
    for _ in range(rounds - len(seen)):
        x, y = np.array(list(seen)) / unit, np.array(list(seen.values()))
        mean, dev = y.mean(), y.std() + 1e-9
        kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) / 0.2) ** 2)
        k = kernel(x, x) + 1e-4 * np.eye(len(x))
        g = grid / unit
        cross = kernel(g, x)
        mu = cross @ np.linalg.solve(k, (y - mean) / dev)
        sd = np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T)), 1e-12))
        z = ((y.min() - mean) / dev - mu) / sd
        gain = sd * (z * 0.5 * (1 + np.vectorize(_erf)(z / np.sqrt(2))) + np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi))
        gain[np.isin(grid, list(seen))] = -1
        if gain.max() <= 0:
            break
        pick = int(grid[gain.argmax()])
        seen[pick] = objective(pick)
    return min(seen, key=lambda n: (seen[n], n)), list(seen.items())


def _erf(x: float) -> float:
    import math

    return math.erf(x)
