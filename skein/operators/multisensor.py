"""Extractors over sensors, and the lanes of concatenated samples.

An extractor is a function from the long cycles of one sensor to (cycle_id, feature_idx, value).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[DataFrame], DataFrame]


def blocks(long: DataFrame, plan: list[tuple[str, str, Extractor]]) -> DataFrame:
    """(cycle_id, block, alg, sensor, feature_idx, value): the features of each (algorithm, sensor, extractor), blocks counted from 1."""
    out = None
    for k, (alg, sensor, extract) in enumerate(plan):
        part = extract(long.where(F.col("sensor") == sensor)).select("cycle_id", F.lit(k + 1).alias("block"), F.lit(alg).alias("alg"), F.lit(sensor).alias("sensor"), "feature_idx", "value")
        out = part if out is None else out.union(part)
    return out


def one_algorithm(long: DataFrame, sensors: list[str], name: str, extract: Extractor) -> DataFrame:
    return blocks(long, [(name, s, extract) for s in sensors])


def all_algorithms(long: DataFrame, sensors: list[str], algorithms: dict[str, Extractor]) -> DataFrame:
    """Algorithm by algorithm, in each sensor by sensor."""
    return blocks(long, [(a, s, e) for a, e in algorithms.items() for s in sensors])


def each_own(long: DataFrame, pairs: list[tuple[str, str, Extractor]]) -> DataFrame:
    """The j-th algorithm on the j-th sensor."""
    return blocks(long, pairs)


def cut(rows: DataFrame, sizes: list[int], percent: float | list[float] = 100.0) -> DataFrame:
    """The first ``percent`` of each block's features (rounded up), numbered through. ``sizes`` are the blocks' numbers of features."""
    share = [percent] * len(sizes) if isinstance(percent, (int, float)) else percent
    kept = [math.ceil(n * p / 100) for n, p in zip(sizes, share, strict=True)]
    start = [sum(kept[:k]) for k in range(len(kept))]
    table = F.broadcast(rows.sparkSession.createDataFrame([(k + 1, n, s) for k, (n, s) in enumerate(zip(kept, start, strict=True))], "block int, kept int, start int"))
    return rows.join(table, "block").where(F.col("feature_idx") <= F.col("kept")).select("cycle_id", "alg", "sensor", (F.col("start") + F.col("feature_idx")).cast("int").alias("feature_idx"), "value")


def decimated(samples: Column, k: int) -> Column:
    """Every k-th sample from the first, unfiltered."""
    return F.filter(samples, lambda x, i: i % k == 0)


def lanes(samples: Column, sizes: list[int]) -> list[Column]:
    """A concatenated row cut back into sensors of the given lengths."""
    return [F.slice(samples, sum(sizes[:k]) + 1, n) for k, n in enumerate(sizes)]


def concatenated(packed: DataFrame, sensors: list[str], column: str = "samples") -> DataFrame:
    """(cycle_id, samples): the sensors' arrays end to end, in the given order; cycles without a sensor are left out."""
    order = F.array_position(F.lit(sensors), F.col("sensor"))
    held = F.array_sort(F.collect_list(F.struct(order.alias("o"), column)))
    return packed.groupBy("cycle_id").agg(held.alias("h")).where(F.size("h") == len(sensors)).select("cycle_id", F.flatten(F.col("h")[column]).alias(column))
