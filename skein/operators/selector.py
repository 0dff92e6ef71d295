"""Choice among whole stacks: cross-validated on shared folds, the best refitted on all cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import evaluate, search, subspace
from skein.operators.stack import FittedStack, Prepared, Stack, extracted, fitted

#: Spark jobs at a time.
JOBS = 4


@dataclass
class Selection:
    """(name, loss) of all candidates from the best, and the best one's stack fitted on all cycles."""

    board: list[tuple[str, float]]
    name: str
    fitted: FittedStack

    def transform(self, cycles: DataFrame) -> DataFrame:
        return self.fitted.transform(cycles)


def dealt(cycles: DataFrame, y: str, folds: int) -> DataFrame:
    """``cycles`` with ``_outer``, the same for all sensors of a cycle: classes dealt evenly, numbers by a hash of the id."""
    if y == "y":
        return cycles.withColumn("_outer", (evaluate.fold_hash() % folds).cast("int"))
    ids = evaluate.stratified_folds(cycles.select("cycle_id", "target").distinct(), folds).select("cycle_id", F.col("fold").alias("_outer"))
    return cycles.join(ids, "cycle_id")


def together(job: Callable, over: Iterable) -> list:
    """``job`` of each, some at a time: small Spark jobs that don't wait for each other's last tasks."""
    with ThreadPoolExecutor(JOBS) as pool:
        return list(pool.map(job, over))


def chosen(table: Prepared, candidates: dict[str, Stack], places: dict[str, list[int]]) -> dict[str, tuple[list[int], object]]:
    """(features, model) of each candidate on one table of all their features. Equal prefilters and rankings are made once, and the
    models of all feature counts of all candidates count their errors in one pass."""
    key = {name: (s.ranker, s.prefilter, tuple(places[name])) for name, s in candidates.items()}
    first = {k: n for n, k in reversed(key.items())}
    made = dict(zip(first, together(lambda n: candidates[n].ranked(table, places[n]), first.values()), strict=True))
    ranks = {name: made[k] for name, k in key.items()}
    if table.y == "y":
        losses = {n: search.regression_losses(None, ranks[n], s.most, parts=table.parts) for n, s in candidates.items()}
    else:
        losses = search.prefix_losses(table.rows, {n: (ranks[n][: s.most], s.metric) for n, s in candidates.items()}, max(s.most for s in candidates.values()), parts=table.parts)
    out = {}
    for name, stack in candidates.items():
        at = ranks[name][: search.best(losses[name])[0]]
        out[name] = (at, stack.model(table, at))
    return out


def board(cycles: DataFrame, candidates: dict[str, Stack], folds: int = 10) -> list[tuple[str, float]]:
    """(name, loss) from the best, ties by name: percent of held-out cycles in the wrong class, or the root of their mean squared error.

    In each fold the extractors are fitted on the other folds, each once for all candidates that use it; so are the features, their
    statistics, the counted errors and the held-out rows. Rankings that need the rows (rank correlations, neighbours) are passes of their own.
    """
    kinds = {s.y for s in candidates.values()}
    inner = {s.folds for s in candidates.values()}
    if len(kinds) != 1 or len(inner) != 1:
        raise ValueError("candidates must share their loss and their inner folds")
    y, inner_folds = kinds.pop(), inner.pop()
    rows = dealt(cycles.where(F.col(y).isNotNull()), y, folds).persist()
    parts = list(dict.fromkeys(p for s in candidates.values() for p in s.parts()))
    names = list(candidates)
    wrong, n = np.zeros(len(names)), 0.0
    for f in sorted(r[0] for r in rows.select("_outer").distinct().collect()):
        train, test = rows.where(F.col("_outer") != f), rows.where(F.col("_outer") == f)
        by_part = dict(zip(parts, together(lambda p, train=train: fitted(train, [p]), parts), strict=True))
        made = [x for p in parts for x in by_part[p]]
        ends = np.cumsum([0, *[len(x.names) for *_, x in made]])
        first = dict(zip(parts, np.cumsum([0, *[len(by_part[p]) for p in parts]]).tolist(), strict=False))
        places = {name: [k for p in s.parts() for k in range(ends[first[p]], ends[first[p] + len(by_part[p])])] for name, s in candidates.items()}
        table = Prepared.of(train, made, y, inner_folds)
        models = chosen(table, candidates, places)
        held = extracted(test, made, (y,))
        if y == "y":
            m = subspace.moments(held, also=("y",))[()]
            last = len(m.mean) - 1
            wrong += [m.of([*at, last]).squares(model.intercept, model.beta) for at, model in models.values()]
            n += m.n
        else:
            count = float(test.select("cycle_id").distinct().count())
            classes = sorted(r[0] for r in rows.select("target").distinct().collect())
            share = search.errors(held.withColumn("fold", F.lit(0)), {0: list(models.values())}, classes)
            wrong += np.array(share) / 100 * count
            n += count
        table.rows.unpersist()
    rows.unpersist()
    losses = np.sqrt(wrong / n) if y == "y" else 100 * wrong / n
    return sorted(zip(names, losses.tolist(), strict=True), key=lambda x: (x[1], x[0]))


def select_stack(cycles: DataFrame, candidates: dict[str, Stack], folds: int = 10) -> Selection:
    """The candidate of the least cross-validated loss, fitted on all cycles."""
    ranked = board(cycles, candidates, folds)
    name = ranked[0][0]
    return Selection(ranked, name, candidates[name].fit(cycles))
