"""Where a feature comes from: rows (feature_idx, sensor, name, src_idx, weight) per stage, composed by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "feature_idx int, sensor string, name string, src_idx array<int>, weight array<double>"


def of_segments(spark: SparkSession, sensor: str, segments: list[tuple[int, int, int]], names: list[str], offset: int = 0) -> DataFrame:
    """Each statistic of a segment comes from the segment's samples, with equal weights."""
    rows = [(offset + (seg - 1) * len(names) + k + 1, sensor, f"{name}_{seg}", list(range(a, b + 1)), [1.0] * max(0, b - a + 1)) for seg, a, b in segments for k, name in enumerate(names)]
    return spark.createDataFrame(rows, SCHEMA)


def of_selection(spark: SparkSession, rank: list[int]) -> DataFrame:
    """Output k of a selector is its k-th ranked input."""
    return spark.createDataFrame([(k + 1, None, None, [f], [1.0]) for k, f in enumerate(rank)], SCHEMA)


def composed(down: DataFrame, up: DataFrame) -> DataFrame:
    """``down``'s sources replaced by their own: one row per feature, sensor and name, weights multiplied and summed per sample; all sources are followed."""
    pairs = down.select("feature_idx", F.explode(F.arrays_zip("src_idx", "weight")).alias("p")).select("feature_idx", F.col("p.src_idx").alias("mid"), F.col("p.weight").alias("w"))
    source = up.select(F.col("feature_idx").alias("mid"), "sensor", "name", F.explode(F.arrays_zip("src_idx", "weight")).alias("p"))
    joined = pairs.join(source, "mid").groupBy("feature_idx", "sensor", "name", F.col("p.src_idx").alias("src")).agg(F.sum(F.col("w") * F.col("p.weight")).alias("weight"))
    held = F.array_sort(F.collect_list(F.struct("src", "weight")))
    return joined.groupBy("feature_idx", "sensor", "name").agg(held.alias("h")).select("feature_idx", "sensor", "name", F.col("h.src").alias("src_idx"), F.col("h.weight").alias("weight"))
