"""Discrete Fourier features: spectra, top coefficients, their uncertainty and the way back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import matrix_udf


def _parts(z: np.ndarray) -> np.ndarray:
    return np.hstack([z.real, z.imag])


def half_spectrum(samples: Column, centred: bool = False, bins: str = "floor") -> Column:
    """Struct of arrays (re, im): the first floor(T/2) bins of the DFT; ``ceil`` gives ceil(T/2) and ``onesided`` floor(T/2)+1."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        keep = {"floor": n // 2, "ceil": -(-n // 2), "onesided": n // 2 + 1}[bins]
        return _parts(np.fft.fft(x - x.mean(axis=1, keepdims=True) if centred else x, axis=1)[:, :keep])

    both = matrix_udf(run)(samples)
    half = (F.size(both) / 2).cast("int")
    return F.struct(F.slice(both, F.lit(1), half).alias("re"), F.slice(both, half + 1, half).alias("im"))


def bins(packed: DataFrame, keys: tuple[str, ...] = ("cycle_id", "sensor"), **kind) -> DataFrame:
    """Long (keys, k from 0, re, im)."""
    rows = packed.select(*keys, half_spectrum(F.col("samples"), **kind).alias("z"))
    return rows.select(*keys, F.posexplode("z.re").alias("k", "re"), "z.im").select(*keys, "k", "re", F.get("im", F.col("k")).alias("im"))


def amplitude() -> Column:
    return F.hypot("re", "im")


def phase() -> Column:
    return F.atan2("im", "re")


def single_sided(packed: DataFrame, keys: tuple[str, ...] = ("cycle_id", "sensor")) -> DataFrame:
    """(keys, k, value): amplitudes of the centred samples over their number, inner bins doubled, floor(T/2)+1 bins."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        a = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) / n
        a[:, 1 : a.shape[1] - 1] *= 2
        return a

    return packed.select(*keys, F.posexplode(matrix_udf(run)(F.col("samples"))).alias("k", "value"))


def rank_bins(long: DataFrame, rank_by: str = "mean_amplitude", by: tuple[str, ...] = ()) -> DataFrame:
    """(k, score): mean amplitude of each bin, or the amplitude of the mean coefficient. Sums are mergeable."""
    score = F.avg(amplitude()) if rank_by == "mean_amplitude" else F.hypot(F.avg("re"), F.avg("im"))
    return long.groupBy(*by, "k").agg(score.alias("score"))


def top_bins(long: DataFrame, n: int | None, rank_by: str = "mean_amplitude") -> DataFrame:
    """The ``n`` best bins (a tenth of them by default), ties to the lower bin."""
    ranked = rank_bins(long, rank_by)
    n = n if n is not None else max(1, ranked.count() // 10)
    return ranked.orderBy(F.desc("score"), "k").limit(n)


def coefficients(long: DataFrame, kept: DataFrame, representation: str = "polar", keys: tuple[str, ...] = ("cycle_id", "sensor")) -> DataFrame:
    """(keys, k, a, b) of the kept bins: amplitude and phase, or real and imaginary parts."""
    a, b = (amplitude(), phase()) if representation == "polar" else (F.col("re"), F.col("im"))
    return long.join(F.broadcast(kept.select("k")), "k").select(*keys, "k", a.alias("a"), b.alias("b"))


def coefficient_uncertainty(long: DataFrame, kept: DataFrame, length: int, representation: str = "polar", keys: tuple[str, ...] = ("cycle_id", "sensor")) -> DataFrame:
    """(keys, k, ua, ub): from three weighted sums of the samples' variances per bin; null where the amplitude is 0.

    ``long`` has samples (t, x, u). Cartesian parts have uncertainties sqrt(sum u^2 cos^2) and sqrt(sum u^2 sin^2).
    """
    angle = 2 * np.pi * F.col("k") * (F.col("t") - 1) / F.lit(float(length))
    rows = long.crossJoin(F.broadcast(kept.select("k"))).withColumn("c", F.cos(angle)).withColumn("s", -F.sin(angle))
    v = F.col("u") * F.col("u")
    sums = rows.groupBy(*keys, "k").agg(
        F.sum(F.col("x") * F.col("c")).alias("re"),
        F.sum(F.col("x") * F.col("s")).alias("im"),
        F.sum(v * F.col("c") * F.col("c")).alias("rr"),
        F.sum(v * F.col("c") * F.col("s")).alias("ri"),
        F.sum(v * F.col("s") * F.col("s")).alias("ii"),
    )
    if representation != "polar":
        return sums.select(*keys, "k", F.sqrt("rr").alias("ua"), F.sqrt("ii").alias("ub"))
    a = F.hypot("re", "im")
    re, im = F.try_divide(F.col("re"), a), F.try_divide(F.col("im"), a)
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    ua = root(re * re * F.col("rr") + 2 * re * im * F.col("ri") + im * im * F.col("ii"))
    ub = F.try_divide(root(im * im * F.col("rr") - 2 * re * im * F.col("ri") + re * re * F.col("ii")), a)
    return sums.select(*keys, "k", ua.alias("ua"), ub.alias("ub"))


def reconstruct(coeffs: DataFrame, length: int, keys: tuple[str, ...] = ("cycle_id", "sensor")) -> DataFrame:
    """(keys, t, x): the real signal of 2*floor(length/2) samples with the kept polar coefficients; bin 0 counts once."""
    n = 2 * (length // 2)
    times = coeffs.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("t"))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2.0)
    value = weight / n * F.col("a") * F.cos(2 * np.pi * F.col("k") * (F.col("t") - 1) / F.lit(float(n)) + F.col("b"))
    return coeffs.crossJoin(F.broadcast(times)).groupBy(*keys, "t").agg(F.sum(value).alias("x"))
