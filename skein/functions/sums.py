"""Sums of arrays over all rows, for iterative fits: added up in each task, then by slots, then by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skein.functions.layout import matrices

SLOTS = 32


def added(rows: DataFrame, fn: Callable[[pd.DataFrame], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums of the arrays that ``fn`` makes of each batch, by key. A task sends one array a key, at most SLOTS of them meet, and the driver gets one."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in fn(batch).items() if len(batch) else ():
                held[k] = held[k] + v if k in held else v
        slot = TaskContext.get().partitionId() % SLOTS
        yield pd.DataFrame([(k, slot, v.ravel()) for k, v in held.items()], columns=["k", "slot", "v"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        out = part.iloc[:1].copy()
        out["v"] = [np.sum(np.stack(part["v"].to_numpy()), axis=0)]
        return out

    kind = "k int, slot int, v array<double>"
    slots = rows.mapInPandas(first, kind).groupBy("k", "slot").applyInPandas(merged, kind)
    found = slots.groupBy("k").applyInPandas(merged, kind).collect()
    return {r.k: np.array(r.v) for r in found}


def strongest(packed: DataFrame, fn: Callable[[np.ndarray], np.ndarray], n: int | None) -> list[int]:
    """Places of the ``n`` columns (a tenth by default) of the largest mean magnitude in what ``fn`` makes of the samples, the largest first, ties to the lower place."""

    def one(batch: pd.DataFrame) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for x in matrices(batch["samples"]):
            z = np.abs(fn(x))
            out[z.shape[1]] = out.get(z.shape[1], 0) + np.append(z.sum(axis=0), len(z))
        return out

    sums = added(packed.select("samples"), one)
    size = max(len(v) - 1 for v in sums.values())
    total, count = np.zeros(size), np.zeros(size)
    for v in sums.values():
        total[: len(v) - 1] += v[:-1]
        count[: len(v) - 1] += v[-1]
    score = total / count
    return np.argsort(-np.where(np.isnan(score), np.inf, score), kind="stable")[: n if n is not None else max(1, size // 10)].tolist()
