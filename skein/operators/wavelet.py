"""Daubechies-2 wavelet coefficients. The transform is linear in the samples, so one matrix per length serves features, uncertainty and the way back."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import matrix_udf

_R = math.sqrt(3)
#: The analysis taps of the Daubechies-2 wavelet.
LOW = np.array([1 - _R, 3 - _R, 3 + _R, 1 + _R]) / (4 * math.sqrt(2))
HIGH = np.array([-(1 + _R), 3 + _R, -(3 - _R), 1 - _R]) / (4 * math.sqrt(2))


def levels(length: int) -> int:
    return max(0, int(math.floor(math.log2(length / 3)))) if length >= 3 else 0


def analyse(x: np.ndarray) -> np.ndarray:
    """Rows of [approximation, coarsest detail, ..., finest detail]. Each level pads three edge samples, filters, and keeps every second output from the fifth."""
    details = []
    for _ in range(levels(x.shape[1])):
        n = x.shape[1]
        at = np.clip(1 + 2 * np.arange((n + 1) // 2 + 1)[:, None] - np.arange(4), 0, n - 1)
        details.append(x[:, at] @ HIGH)
        x = x[:, at] @ LOW
    return np.hstack([x, *details[::-1]])


@lru_cache(8)
def matrix(length: int) -> np.ndarray:
    """Coefficients by samples."""
    return analyse(np.eye(length)).T


def coefficients(samples: Column) -> Column:
    return matrix_udf(analyse)(samples)


def uncertainty(u: Column) -> Column:
    """Standard uncertainty of every coefficient from that of independent samples."""
    return matrix_udf(lambda x: np.sqrt((x * x) @ (matrix(x.shape[1]) ** 2).T))(u)


def reconstruct(coeffs: Column, length: int) -> Column:
    """Samples of least squares: exact for all coefficients; dropped ones are zeros."""
    back = np.linalg.pinv(matrix(length)).T
    return matrix_udf(lambda c: c @ back)(coeffs)


def mean_magnitudes(long: DataFrame) -> DataFrame:
    """(idx, total, n) of |coefficient|: mergeable sums over (idx, value)."""
    return long.groupBy("idx").agg(F.sum(F.abs("value")).alias("total"), F.count("value").alias("n"))


def top(long: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` coefficients (a tenth by default) of the largest mean magnitude, ties to the lower index."""
    sums = mean_magnitudes(long)
    n = n if n is not None else max(1, sums.count() // 10)
    return sums.select("idx", (F.col("total") / F.col("n")).alias("score")).orderBy(F.desc("score"), "idx").limit(n)


def elbow(scores: list[float]) -> int:
    """How many of descending scores to keep: up to the point farthest from the chord of first and last."""
    y = np.asarray(scores, float)
    if len(y) < 3:
        return len(y)
    k = np.arange(len(y))
    return int(np.argmax(np.abs(y[0] + (y[-1] - y[0]) * k / k[-1] - y))) + 1
