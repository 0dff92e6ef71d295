"""Automatic sections: edges of the mean cycle of a sensor divide it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_cycle(long: DataFrame) -> DataFrame:
    return long.groupBy("t").agg(F.avg("x").alias("mean"))


def transitions(long: DataFrame, width: int) -> DataFrame:
    """(t, mean, moving_max, rising, falling): where the mean cycle crosses its own mean. One row per sample of a cycle, so one ordered window."""
    curve = mean_cycle(long)
    w = Window.orderBy("t")
    half = width // 2
    up = F.col("mean") > F.col("_level")
    rows = curve.crossJoin(F.broadcast(curve.agg(F.avg("mean").alias("_level")))).withColumn("_up", up)
    before = F.lag("_up").over(w)
    return rows.select(
        "t",
        "mean",
        F.max("mean").over(w.rowsBetween(-half, half)).alias("moving_max"),
        F.coalesce(F.col("_up") & ~before, F.lit(False)).alias("rising"),
        F.coalesce(~F.col("_up") & before, F.lit(False)).alias("falling"),
    )


def edges(curve: np.ndarray) -> list[int]:
    """Samples (1-based) where the absolute central difference is a local maximum above twice its root mean square."""
    d = np.abs(np.gradient(curve))
    high = d > 2 * np.sqrt((d * d).mean())
    peak = (d >= np.append(-np.inf, d[:-1])) & (d > np.append(d[1:], -np.inf))
    return (np.flatnonzero(high & peak) + 1).tolist()


def sections(long: DataFrame, length: int) -> list[tuple[int, int, int]]:
    """Segments between the edges, wide edges (a moving maximum of their marks) being sections of their own; neighbours share borders."""
    curve = mean_cycle(long).orderBy("t").toPandas()["mean"].to_numpy()
    reach = (-(-length // 500) + 1) // 2
    marks = np.zeros(length + 2, bool)
    for t in edges(curve):
        marks[max(1, t - reach) : min(length, t + reach) + 1] = True
    marks[[0, length + 1]] = False
    change = np.flatnonzero(marks[1:] != marks[:-1])
    cuts = sorted({1, length, *[int(min(max(c, 1), length)) for c in change]})
    return [(k + 1, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
