"""Segments of a cycle, and statistics and their uncertainty in each.

A segments table is (seg, t_start, t_stop), a few rows, so it is broadcast; a sample may lie in several segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NINE = ["rms", "var", "slope", "argmax", "max", "min", "skew", "kurt", "crest"]
MOMENTS = ["mean", "std", "skew", "kurt"]
EIGHT = ["std", "skew", "kurt", "max", "argmax", "min", "mean", "slope"]


def tumbling(length: int, n: int) -> list[tuple[int, int, int]]:
    """Segments of ceil(length / n) samples; the last are shorter or empty."""
    width = -(-length // n)
    return [(k + 1, k * width + 1, min(length, (k + 1) * width)) for k in range(n)]


def overlapping(length: int, n: int) -> list[tuple[int, int, int]]:
    """Starts by the floor and stops by the ceiling of length / n, so neighbours may share samples."""
    return [(k + 1, k * (length // n) + 1, min(length, (k + 1) * -(-length // n))) for k in range(n)]


def given(bounds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    return [(k + 1, a, b) for k, (a, b) in enumerate(bounds)]


def frequency_bands(bands: list[tuple[float, float]], rate: float, length: int) -> list[tuple[int, int, int]]:
    """Hz ranges snapped to the nearest bins (1-based) of a spectrum of ``length`` samples."""
    step = rate / length
    nearest = lambda hz: min(range(length // 2 + 1), key=lambda k: (abs(k * step - hz), k)) + 1
    return [(k + 1, nearest(a), nearest(b)) for k, (a, b) in enumerate(bands)]


def segments_table(spark: SparkSession, segments: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(segments, "seg int, t_start int, t_stop int")


def in_segments(long: DataFrame, segments: list[tuple[int, int, int]]) -> DataFrame:
    """``long`` with ``seg`` and the place in it (``pos`` from 1), one row per sample and segment."""
    held = F.broadcast(segments_table(long.sparkSession, segments))
    return long.join(held, F.col("t").between(F.col("t_start"), F.col("t_stop"))).withColumn("pos", F.col("t") - F.col("t_start") + 1).drop("t_start", "t_stop")


def statistic(name: str, x: Column, t: Column) -> Column:
    """An aggregate over a segment. ``argmax`` is the first place of the maximum."""
    rms = F.sqrt(F.avg(x * x))
    return {
        "mean": lambda: F.avg(x),
        "std": lambda: F.stddev_samp(x),
        "var": lambda: F.var_samp(x),
        "skew": lambda: F.skewness(x),
        "kurt": lambda: F.kurtosis(x) + 3,
        "rms": lambda: rms,
        "slope": lambda: F.regr_slope(x, t.cast("double")),
        "argmax": lambda: F.max_by(t, F.struct(x, -t)),
        "max": lambda: F.max(x),
        "min": lambda: F.min(x),
        "crest": lambda: F.try_divide(F.max(x), rms),
        "sse": lambda: F.regr_syy(x, t.cast("double")) - F.coalesce(F.try_divide(F.regr_sxy(x, t.cast("double")) ** 2, F.regr_sxx(x, t.cast("double"))), F.lit(0.0)),
    }[name]()


def segment_statistics(held: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row per key and segment. NaN samples are left out."""
    x = F.when(~F.isnan("x"), F.col("x"))
    return held.groupBy(*keys, "seg").agg(*[statistic(n, x, F.col("pos")).cast("double").alias(n) for n in names])


def features(held: DataFrame, names: list[str], segments: list[tuple[int, int, int]], keys: list[str]) -> DataFrame:
    """(keys, feature_idx, value): all statistics of a segment, segments left to right; empty segments give null."""
    stats = segment_statistics(held, names, keys)
    grid = held.select(*keys).distinct().crossJoin(F.broadcast(segments_table(held.sparkSession, segments).select("seg")))
    full = grid.join(stats, [*keys, "seg"], "left")
    items = [F.struct(((F.col("seg") - 1) * len(names) + k + 1).alias("feature_idx"), F.col(n).alias("value")) for k, n in enumerate(names)]
    return full.select(*keys, F.explode(F.array(*items)).alias("f")).select(*keys, "f.feature_idx", "f.value")


def sensitivities(names: list[str]) -> dict[str, Column]:
    """Derivative of each statistic by a sample, over the windows' columns that ``propagated`` makes."""
    n, d, m2, m3, m4 = F.col("n"), F.col("d"), F.col("m2"), F.col("m3"), F.col("m4")
    rms, x, peak = F.col("rms"), F.col("x"), F.col("peak")
    at = lambda c: F.when(F.col("pos") == F.col(c), 1.0).otherwise(0.0)
    every = {
        "mean": 1 / n,
        "std": F.try_divide(d, (n - 1) * F.sqrt(m2 * F.try_divide(n, n - 1))),
        "var": F.try_divide(2 * d, n - 1),
        "skew": 3 / n * (F.try_divide(d * d - m2, F.pow(m2, 1.5)) - F.try_divide(m3 * d, F.pow(m2, 2.5))),
        "kurt": 4 / n * (F.try_divide(d * d * d - m3, m2 * m2) - F.try_divide(m4 * d, m2 * m2 * m2)),
        "rms": F.try_divide(x, n * rms),
        "slope": F.try_divide(F.col("dt"), F.col("stt")),
        "argmax": F.lit(0.0),
        "max": at("p_max"),
        "min": at("p_min"),
        "crest": F.try_divide(at("p_max"), rms) - F.try_divide(peak * x, n * rms * rms * rms),
    }
    return {k: every[k] for k in names}


def propagated(held: DataFrame, names: list[str], keys: list[str], input_is_variance: bool = False) -> DataFrame:
    """Standard uncertainty of each statistic: the root of the summed squares of sensitivity times ``u``, one row per key and segment."""
    w = Window.partitionBy(*keys, "seg")
    x, t = F.col("x"), F.col("pos").cast("double")
    one = held.select("*", F.count("x").over(w).cast("double").alias("n"), (x - F.avg("x").over(w)).alias("d"), (t - F.avg(t).over(w)).alias("dt"), F.sqrt(F.avg(x * x).over(w)).alias("rms"), F.max("x").over(w).alias("peak"), F.max_by("pos", F.struct("x", -F.col("pos"))).over(w).alias("p_max"), F.min_by("pos", F.struct("x", "pos")).over(w).alias("p_min"))
    d = F.col("d")
    two = one.select("*", F.avg(d * d).over(w).alias("m2"), F.avg(d * d * d).over(w).alias("m3"), F.avg(d * d * d * d).over(w).alias("m4"), F.sum(F.col("dt") * F.col("dt")).over(w).alias("stt"))
    v = F.col("u") if input_is_variance else F.col("u") * F.col("u")
    return two.groupBy(*keys, "seg").agg(*[F.sqrt(F.sum(c * c * v)).alias(k) for k, c in sensitivities(names).items()])
