"""Bayesian choice of a whole pipeline: an extractor for each sensor, ranker, learner and number of features at once.

A Gaussian process over categories and counts proposes points; a batch of them is scored in one pass over the rows. All
extractors are fitted and applied once, and the statistics of folds and classes are taken once, whatever is proposed later.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from skein.operators import search
from skein.operators.stack import FittedStack, Prepared, Stack, fitted

#: A choice of each category, and a count.
Point = tuple[tuple[str, ...], int]


@dataclass(frozen=True)
class Space:
    """The options of each category, and counts of 1 to ``most`` (near when their ratio is near 1)."""

    options: tuple[tuple[str, ...], ...]
    most: int

    @property
    def size(self) -> int:
        return math.prod(len(o) for o in self.options) * self.most

    def drawn(self, rng: np.random.Generator) -> Point:
        return tuple(o[rng.integers(len(o))] for o in self.options), min(self.most, int(self.most ** rng.random() + 0.5))

    def near(self, point: Point, rng: np.random.Generator) -> Point:
        """The point with one category drawn anew, or with another count."""
        names, count = list(point[0]), point[1]
        k = int(rng.integers(len(names) + 1))
        if k < len(names):
            names[k] = self.options[k][rng.integers(len(self.options[k]))]
        else:
            count = int(np.clip(round(count * math.exp(rng.normal(0, 0.4)) + rng.integers(-1, 2)), 1, self.most))
        return tuple(names), count

    def kernel(self, a: list[Point], b: list[Point], scale: float = 0.3, categories: float = 1.5) -> np.ndarray:
        """Likeness: falls with the log ratio of the counts (a share ``scale`` of the range) and with each differing category."""
        place = [{o: k for k, o in enumerate(options)} for options in self.options]
        ia, ib = (np.array([[p[x] for p, x in zip(place, names, strict=True)] for names, _ in points]).reshape(len(points), -1) for points in (a, b))
        la, lb = (np.log([n for _, n in points]) / max(math.log(self.most), 1e-9) for points in (a, b))
        differ = (ia[:, None, :] != ib[None]).sum(axis=2)
        return np.exp(-0.5 * ((la[:, None] - lb[None]) / scale) ** 2 - differ / categories)


def _improvement(space: Space, seen: dict[Point, float], asked: list[Point], noise: float) -> np.ndarray:
    """The expected fall below the least loss seen, in deviations of the losses, at each asked point."""
    points, y = list(seen), np.array(list(seen.values()))
    z = (y - y.mean()) / (y.std() + 1e-12)
    k = space.kernel(points, points) + noise * np.eye(len(points))
    cross = space.kernel(asked, points)
    mu = cross @ np.linalg.solve(k, z)
    sd = np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T)), 1e-12))
    t = (z.min() - mu) / sd
    density, below = np.exp(-0.5 * t * t) / math.sqrt(2 * math.pi), 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in t]))
    return sd * (t * below + density)


def minimise(space: Space, objective: Callable[[list[Point]], list[float]], rounds: int = 10, batch: int = 4, seed: int = 11, pool: int = 500, noise: float = 1e-3, seen: dict[Point, float] | None = None) -> dict[Point, float]:
    """Losses of all points tried, in their order; with ``seen`` an earlier search goes on.

    A new search starts with a random batch. In a batch a proposed point counts with its expected loss until its own is known
    (the least seen), so proposals of a round spread. The rounds end early when the space is used up.
    """
    rng = np.random.default_rng([seed, len(seen or {})])
    found = dict(seen or {})
    for _ in range(rounds):
        held, picks = dict(found), []
        for _ in range(min(batch, space.size - len(found))):
            best = sorted(held, key=held.get)[:5]
            fresh = [space.drawn(rng) for _ in range(pool)] + [space.near(best[k % len(best)], rng) for k in range(pool if best else 0)]
            fresh = [p for p in dict.fromkeys(fresh) if p not in held]
            if not fresh:
                break
            pick = fresh[int(_improvement(space, held, fresh, noise).argmax())] if found else fresh[0]
            picks.append(pick)
            held[pick] = min(found.values(), default=0.0)
        if not picks:
            break
        found |= dict(zip(picks, objective(picks), strict=True))
    return found


@dataclass
class Optimised:
    """Losses of all points tried (percent of held-out cycles in the wrong class), the best point and its fitted stack."""

    history: dict[Point, float]
    point: Point
    fitted: FittedStack

    def transform(self, cycles: DataFrame) -> DataFrame:
        return self.fitted.transform(cycles)


class Pipelines:
    """Stacks over one table of the features of every sensor and extractor, with the statistics of its folds and classes."""

    def __init__(self, cycles: DataFrame, extractors: tuple[str, ...], folds: int = 10, prefilter: int = 500):
        self.made = fitted(cycles, [(e, None) for e in extractors])
        self.sensors = sorted({s for s, *_ in self.made})
        ends = np.cumsum([0, *[len(x.names) for *_, x in self.made]]).tolist()
        self.places = {(s, e): list(range(a, b)) for (s, e, _), a, b in zip(self.made, ends[:-1], ends[1:], strict=True)}
        self.table = Prepared.of(cycles, self.made, "target", folds)
        self.prefilter = prefilter
        self.classes = sorted({k[1] for k in self.table.parts})
        rows, parts = self.table.rows, self.table.parts
        self.others = {f: Prepared(rows.where(rows["fold"] != f), "target", {k: m for k, m in parts.items() if k[0] != f}) for f in sorted({k[0] for k in parts})}
        self.ranks: dict[tuple, list[int]] = {}

    def _chosen(self, names: tuple[str, ...]) -> tuple[list[tuple[str, str]], Stack]:
        *extractors, ranker, learner = names
        return list(zip(self.sensors, extractors, strict=True)), Stack([], ranker, learner, self.prefilter)

    def model(self, names: tuple[str, ...], count: int, table: Prepared, part: int | None = None) -> tuple[list[int], object]:
        """Places of the first ``count`` features of the ranking (all, where they are fewer), and the learner's model of them. A part's rankings are kept."""
        pairs, stack = self._chosen(names)
        key = (part, *names[:-1])
        if key not in self.ranks:
            self.ranks[key] = stack.ranked(table, [p for pair in pairs for p in self.places[pair]])
        at = self.ranks[key][:count]
        return at, stack.model(table, at)

    def losses(self, points: list[Point]) -> list[float]:
        """Ranked, counted and fitted on the other folds each; the errors of all points and folds are counted in one pass."""
        models = {f: [self.model(names, count, table, f) for names, count in points] for f, table in self.others.items()}
        return search.errors(self.table.rows, models, self.classes)

    def fit(self, point: Point, loss: float) -> FittedStack:
        names, count = point
        at, model = self.model(names, count, self.table)
        pairs, _ = self._chosen(names)
        own = [m for m in self.made if (m[0], m[1]) in pairs]
        local = {p: k for k, p in enumerate(p for s, e, _ in own for p in self.places[s, e])}
        return FittedStack(own, [local[p] for p in at], model, [(len(at), loss)], loss)


def optimise(
    cycles: DataFrame,
    extractors: tuple[str, ...] = ("piecewise", "wavelet", "fourier", "principal", "moments"),
    rankers: tuple[str, ...] = ("pearson", "relief", "elimination"),
    learners: tuple[str, ...] = ("lda", "lda-euclidean"),
    most: int = 500,
    rounds: int = 10,
    batch: int = 3,
    folds: int = 10,
    seed: int = 11,
    history: dict[Point, float] | None = None,
) -> Optimised:
    """The stack of the least cross-validated loss that the search finds (the first of equals), fitted on all cycles with a target.

    Sensors choose their extractors apart. ``history`` of an earlier search on the same cycles and folds is gone on from. Extractors are
    fitted on all cycles; rankings, counts and models on the other folds only. Rankings by neighbours are passes of their own.
    """
    made = Pipelines(cycles.where(cycles["target"].isNotNull()), extractors, folds)
    widest = sum(max(len(made.places[s, e]) for e in extractors) for s in made.sensors)
    space = Space((*[tuple(extractors)] * len(made.sensors), tuple(rankers), tuple(learners)), min(most, widest))
    found = minimise(space, made.losses, rounds, batch, seed, seen=history)
    point = min(found, key=found.get)
    out = Optimised(found, point, made.fit(point, found[point]))
    made.table.rows.unpersist()
    return out
