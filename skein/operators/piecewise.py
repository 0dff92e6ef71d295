"""Adaptive piecewise-linear approximation: squared errors of all intervals, optimal breakpoints, features of the pieces.

Errors add over cycles: each task sums its own triangle from running sums, Spark sums the tasks', and the
dynamic programme over at most a few hundred samples runs on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SPLITS = 70


def interval_errors(packed: DataFrame) -> DataFrame:
    """(i, j, sse): for each interval of samples i < j the squared error of its own least-squares line, summed over all cycles of one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["samples"].to_numpy()).astype(float)
            x -= x.mean(axis=1, keepdims=True)
            t = np.arange(x.shape[1], dtype=float)
            zero = np.zeros((len(x), 1))
            sx, sxx, stx = (np.hstack([zero, np.cumsum(v, axis=1)]) for v in (x, x * x, x * t))
            st, stt = (np.concatenate([[0], np.cumsum(v)]) for v in (t, t * t))
            parts = []
            for i in range(len(t) - 1):
                n = np.arange(2, len(t) - i + 1.0)
                ct = st[i + 2 :] - st[i]
                ctt = stt[i + 2 :] - stt[i] - ct * ct / n
                cx = sx[:, i + 2 :] - sx[:, [i]]
                cxx = sxx[:, i + 2 :] - sxx[:, [i]] - cx * cx / n
                ctx = stx[:, i + 2 :] - stx[:, [i]] - ct * cx / n
                parts.append(np.maximum(cxx - ctx * ctx / ctt, 0).sum(axis=0))
            held[len(t)] = [a + b for a, b in zip(held[len(t)], parts, strict=True)] if len(t) in held else parts
        for size, parts in held.items():
            for i, sse in enumerate(parts):
                yield pd.DataFrame({"i": i + 1, "j": np.arange(i + 2, size + 1), "sse": sse})

    return packed.select("samples").mapInPandas(run, "i int, j int, sse double").groupBy("i", "j").agg(F.sum("sse").alias("sse"))


def error_matrix(errors: DataFrame) -> np.ndarray:
    """The triangle as a matrix (at most a few hundred samples square), infinite below."""
    rows = errors.toPandas()
    size = int(rows["j"].max())
    out = np.full((size, size), np.inf)
    out[rows["i"] - 1, rows["j"] - 1] = rows["sse"]
    return out


def best_splits(sse: np.ndarray, most: int) -> list[tuple[float, list[int]]]:
    """For 1..most splits the least error and the splits (1-based samples that both neighbours share)."""
    size = len(sse)
    cost, choice, out = sse[:, -1].copy(), [], []
    for _ in range(min(most, size - 2)):
        through = sse + cost[None, :]
        choice.append(through.argmin(axis=1))
        cost = through.min(axis=1)
        splits, at = [], 0
        for pick in reversed(choice):
            at = int(pick[at])
            splits.append(at + 1)
        out.append((float(cost[0]), splits))
    return out


def automatic_splits(sse: np.ndarray, most: int = MOST_SPLITS) -> list[int]:
    """The number of splits at the last of three breaks of a four-line fit to the error curve, and those splits."""
    found = best_splits(sse, most)
    curve = np.array([e for e, _ in found])
    if len(curve) < 6:
        return found[-1][1]
    t = np.arange(len(curve), dtype=float)
    lines = np.full((len(t), len(t)), np.inf)
    for i in range(len(t) - 1):
        for j in range(i + 1, len(t)):
            fit = np.polyfit(t[i : j + 1], curve[i : j + 1], 1) if j > i + 1 else None
            lines[i, j] = 0.0 if fit is None else float(((np.polyval(fit, t[i : j + 1]) - curve[i : j + 1]) ** 2).sum())
    return found[best_splits(lines, 3)[-1][1][-1] - 1][1]


def splits_for(sse: np.ndarray, n_features: int | None) -> list[int]:
    """floor(n/2) - 1 splits for n >= 4 features of two statistics, or an automatic number."""
    if n_features is None:
        return automatic_splits(sse)
    if n_features < 4:
        raise ValueError("two intervals of two features are the least")
    return best_splits(sse, n_features // 2 - 1)[-1][1]


def intervals(splits: list[int], length: int) -> list[tuple[int, int, int]]:
    """Segments that share their border samples."""
    return [(k + 1, a, b) for k, (a, b) in enumerate(zip([1, *splits], [*splits, length], strict=True))]


def reconstruct(lines: DataFrame, length: int) -> DataFrame:
    """(cycle_id, t, x) from (cycle_id, seg, t_start, t_stop, mean, slope): a border belongs to the piece on its left."""
    t = F.explode(F.sequence(F.when(F.col("seg") == 1, F.col("t_start")).otherwise(F.col("t_start") + 1), F.col("t_stop"))).alias("t")
    rows = lines.select("cycle_id", "mean", "slope", "t_start", "t_stop", t)
    return rows.select("cycle_id", "t", (F.col("mean") + F.col("slope") * (F.col("t") - (F.col("t_start") + F.col("t_stop")) / 2)).alias("x"))
