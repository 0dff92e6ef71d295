"""Time-frequency features: nine statistics of time segments, and of frequency segments of each time segment's own spectrum.

The spectrum of a segment is that of its samples less their mean: amplitudes over the number of samples, inner bins doubled,
floor(L/2)+1 bins. Uncertainties are carried from the samples through amplitudes to statistics by one Jacobian, so bins that
share samples stay correlated. Cycles are packed rows, so all of it is a narrow map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import matrix_udf, pair_udf
from skein.operators import segments

#: Statistics whose derivatives miss that another sample may take over as the largest or least one.
ORDER = ["argmax", "max", "min", "crest"]


def nine(x: np.ndarray) -> np.ndarray:
    """(rows, 9): the statistics NINE of each row; NaN where one is undefined."""
    n = x.shape[1]
    out = np.full((len(x), 9), np.nan)
    if not n:
        return out
    t = np.arange(1, n + 1) - (n + 1) / 2
    d = x - x.mean(axis=1, keepdims=True)
    m2, m3, m4 = ((d**p).mean(axis=1) for p in (2, 3, 4))
    rms, peak = np.sqrt((x * x).mean(axis=1)), x.max(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 0] = rms
        out[:, 1] = m2 * n / (n - 1) if n > 1 else np.nan
        out[:, 2] = d @ t / (t @ t) if n > 1 else np.nan
        out[:, 3], out[:, 4], out[:, 5] = x.argmax(axis=1) + 1, peak, x.min(axis=1)
        out[:, 6], out[:, 7] = np.where(m2 > 0, m3 / m2**1.5, np.nan), np.where(m2 > 0, m4 / m2**2, np.nan)
        out[:, 8] = np.where(rms > 0, peak / rms, np.nan)
    return out


def extremes(x: np.ndarray) -> np.ndarray:
    """(rows, 4): the statistics ORDER of each row alone, as ``nine`` has them."""
    n = x.shape[1]
    out = np.full((len(x), 4), np.nan)
    if not n:
        return out
    rms, top = np.sqrt((x * x).mean(axis=1)), x.argmax(axis=1)
    peak = x[np.arange(len(x)), top]
    out[:, 0], out[:, 1], out[:, 2] = top + 1, peak, x.min(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 3] = np.where(rms > 0, peak / rms, np.nan)
    return out


def nine_derivatives(x: np.ndarray) -> np.ndarray:
    """(rows, 9, samples): of each statistic by each sample; that of a position is 0, those of the largest and least stand at their first place."""
    rows, n = x.shape
    out = np.zeros((rows, 9, n))
    if not n:
        return out
    t = np.arange(1, n + 1) - (n + 1) / 2
    d = x - x.mean(axis=1, keepdims=True)
    m2, m3, m4 = ((d**p).mean(axis=1)[:, None] for p in (2, 3, 4))
    rms, peak = np.sqrt((x * x).mean(axis=1))[:, None], x.max(axis=1)[:, None]
    at = lambda k: (np.arange(n)[None] == k[:, None]).astype(float)
    top = at(x.argmax(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 0] = x / (n * rms)
        out[:, 1] = 2 * d / (n - 1) if n > 1 else np.nan
        out[:, 2] = t / (t @ t) if n > 1 else np.nan
        out[:, 4], out[:, 5] = top, at(x.argmin(axis=1))
        out[:, 6] = 3 / n * ((d * d - m2) / m2**1.5 - m3 * d / m2**2.5)
        out[:, 7] = 4 / n * ((d**3 - m3) / m2**2 - m4 * d / m2**3)
        out[:, 8] = top / rms - peak * x / (n * rms**3)
    return out


def _weights(n: int, scaled: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bins, samples) of cosines and negative sines of the centred samples' spectrum, times its scale; bin 0 is zero."""
    count = n // 2 + 1 if scaled else -(-n // 2)
    k = np.arange(count)
    angle = 2 * np.pi * k[:, None] * np.arange(n)[None] / max(n, 1)
    size = np.full(count, 1.0 / max(n, 1) if scaled else 1.0)
    if scaled:
        size[1:-1] *= 2
    c, s = np.cos(angle) * size[:, None], -np.sin(angle) * size[:, None]
    if scaled:
        c[0], s[0] = 0.0, 0.0
    if n % 2 == 0 and count > n // 2:
        s[n // 2] = 0.0
    return c, s


@dataclass
class TimeFrequency:
    """Features [time statistics of all segments][frequency statistics by segment]. ``scope`` ``segment`` takes each segment's scaled spectrum, ``cycle`` the plain
    magnitudes of the first ceil(T/2) bins of the whole cycle. Segments are equal parts, neighbours may share a sample; or
    ``time`` and ``hertz`` give their bounds (samples from 1; Hz at ``rate``)."""

    n_time: int = 10
    n_freq: int = 10
    rate: float = 1.0
    scope: str = "segment"
    time: list[tuple[int, int]] | None = None
    hertz: list[tuple[float, float]] | None = None

    def time_segments(self, length: int) -> list[tuple[int, int, int]]:
        found = segments.given(self.time) if self.time else segments.overlapping(length, self.n_time)
        return [(k, a, min(b, length)) for k, a, b in found]

    def spectra(self, length: int) -> list[tuple[int, int, int]]:
        """What spectra are taken of."""
        return self.time_segments(length) if self.scope == "segment" else [(1, 1, length)]

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """Bins (from 1) of the frequency segments of a spectrum of ``n`` samples."""
        if self.hertz:
            return segments.frequency_bands(self.hertz, self.rate, n)
        count = n // 2 + 1 if self.scope == "segment" else -(-n // 2)
        return [(k, a, min(b, count)) for k, a, b in segments.overlapping(count, self.n_freq)]

    def names(self, length: int) -> list[str]:
        own = [f"{s}_t{k}" for k, *_ in self.time_segments(length) for s in segments.NINE]
        return own + [f"{s}_t{k}_f{j}" for k, a, b in self.spectra(length) for j, *_ in self.bands(b - a + 1) for s in segments.NINE]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """Features of cycles of one length."""
        out = [nine(x[:, a - 1 : b]) for _, a, b in self.time_segments(x.shape[1])]
        for _, a, b in self.spectra(x.shape[1]):
            s = self._amplitudes(x[:, a - 1 : b])[0]
            out += [nine(s[:, lo - 1 : hi]) for _, lo, hi in self.bands(b - a + 1)]
        return np.hstack(out)

    def _amplitudes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c, s = _weights(x.shape[1], self.scope == "segment")
        x = x - x.mean(axis=1, keepdims=True) if self.scope == "segment" and x.shape[1] else x
        re, im = x @ c.T, x @ s.T
        amplitude = np.hypot(re, im)
        if self.scope == "segment":
            amplitude[:, 0] = 0.0
        return amplitude, re, im, c, s

    def variances(self, x: np.ndarray, v: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Variances of the features, from those of the samples."""
        return np.vstack([self._variances(x[k : k + chunk], v[k : k + chunk]) for k in range(0, len(x), chunk)]) if len(x) else np.zeros((0, len(self.names(x.shape[1]))))

    def _variances(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = [((nine_derivatives(x[:, a - 1 : b]) ** 2) * v[:, None, a - 1 : b]).sum(axis=2) for _, a, b in self.time_segments(x.shape[1])]
        for _, a, b in self.spectra(x.shape[1]):
            amplitude, re, im, c, s = self._amplitudes(x[:, a - 1 : b])
            with np.errstate(divide="ignore", invalid="ignore"):
                by_sample = (re[:, :, None] * c[None] + im[:, :, None] * s[None]) / amplitude[:, :, None]
            if self.scope == "segment":
                by_sample[:, 0] = 0.0
            for _, lo, hi in self.bands(b - a + 1):
                chain = nine_derivatives(amplitude[:, lo - 1 : hi]) @ by_sample[:, lo - 1 : hi]
                out.append(((chain**2) * v[:, None, a - 1 : b]).sum(axis=2))
        return np.hstack(out)

    def features(self, samples: Column) -> Column:
        return matrix_udf(self.matrix)(samples)

    def uncertainty(self, samples: Column, u: Column, input_is_variance: bool = False) -> Column:
        """Standard uncertainties; null where a statistic or an amplitude of 0 has no derivative."""
        return pair_udf(lambda x, e: np.sqrt(self.variances(x, e if input_is_variance else e * e)))(samples, u)


def simulated(packed: DataFrame, bounds: list[tuple[int, int, int]], runs: int = 1_000_000, unit: int = 1000, blocks: int = 1, seed: int = 1, keys: tuple[str, ...] = ("cycle_id", "sensor")) -> DataFrame:
    """(keys, seg, statistic, mean, u, runs): mean and deviation of ORDER over ``runs`` draws of normal noise ``u`` on ``samples``.

    Draws come in units, seeded by the key and the unit's number, and a cycle's units are dealt over ``blocks`` tasks: one very noisy
    cycle, or a million draws, spreads over the cluster. A unit keeps its sums around the undisturbed statistic, so units and
    blocks merge by plain sums; any ``blocks`` gives the same result but for rounding. The crest factor is of the segment.
    """
    units = -(-runs // unit)
    names = [f"{s}_{k}" for k, *_ in bounds for s in ORDER]

    def statistics(x: np.ndarray) -> np.ndarray:
        return np.hstack([extremes(x[:, a - 1 : b]) for _, a, b in bounds])

    @F.pandas_udf("array<struct<n:double,s:double,q:double>>")
    def draw(x: pd.Series, u: pd.Series, key: pd.Series, block: pd.Series) -> pd.Series:
        out = []
        for samples, noise, own, b in zip(x, u, key, block, strict=True):
            samples, noise = np.asarray(samples, float), np.asarray(noise, float)
            centre = statistics(samples[None])[0]
            n, s, q = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
            for k in range(b, units, blocks):
                rng = np.random.default_rng([seed, own & 0xFFFFFFFFFFFFFFFF, k])
                d = statistics(samples + rng.standard_normal((min(unit, runs - k * unit), len(samples))) * noise) - centre
                ok = np.isfinite(d)
                d = np.where(ok, d, 0.0)
                n, s, q = n + ok.sum(axis=0), s + d.sum(axis=0), q + (d * d).sum(axis=0)
            out.append([{"n": a, "s": c, "q": e} for a, c, e in zip(n, s, q, strict=True)])
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def still(x: pd.Series) -> pd.Series:
        return pd.Series([statistics(np.asarray(v, float)[None])[0] for v in x])

    rows = packed.select(*keys, "samples", "u", F.xxhash64(*keys).alias("_key"))
    dealt = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks > 1:
        dealt = dealt.repartition(*keys, "_block")
    drawn = dealt.select(*keys, F.posexplode(draw("samples", "u", "_key", "_block")).alias("_i", "_d")).groupBy(*keys, "_i").agg(*[F.sum(f"_d.{c}").alias(f"_{c}") for c in "nsq"])
    centres = rows.select(*keys, F.posexplode(still("samples")).alias("_i", "_centre"))
    found = drawn.join(centres, [*keys, "_i"])
    n, shift = F.col("_n"), F.try_divide(F.col("_s"), F.col("_n"))
    of = F.array(*[F.struct(F.lit(k).alias("seg"), F.lit(s).alias("statistic")) for k, *_ in bounds for s in ORDER])[F.col("_i")]
    spread = F.sqrt(F.greatest(F.try_divide(F.col("_q") - n * shift * shift, n - 1), F.lit(0.0)))
    return found.select(*keys, of["seg"].alias("seg"), of["statistic"].alias("statistic"), (F.col("_centre") + shift).alias("mean"), spread.alias("u"), n.cast("long").alias("runs"))
