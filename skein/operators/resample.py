"""Anti-aliased resampling, and the sinc filter bank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from skein.functions.layout import matrix_udf


def factor(length: int, target: int = 500, plus: int = 1) -> int:
    """1 up to ``target`` samples, else round(length / target) + plus."""
    return 1 if length <= target else int(np.floor(length / target + 0.5)) + plus


def low_pass(q: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Kaiser-windowed sinc of 2 * half * q + 1 taps that sum to 1, cut at 1/q of the band."""
    k = np.arange(-half * q, half * q + 1)
    taps = np.sinc(k / q) * np.kaiser(len(k), beta)
    return taps / taps.sum()


def filtered(x: np.ndarray, taps: np.ndarray, step: int = 1) -> np.ndarray:
    """Centred convolution of rows with zeros beyond their ends, at every ``step``-th sample."""
    half = len(taps) // 2
    padded = np.pad(x, ((0, 0), (half, half)))
    return np.lib.stride_tricks.sliding_window_view(padded, len(taps), axis=1)[:, ::step] @ taps[::-1]


def decimate(samples: Column, q: int, taps: np.ndarray | None = None) -> Column:
    """Low-pass and every q-th sample: ceil(T / q) values."""
    own = low_pass(q) if taps is None else taps
    return matrix_udf(lambda x: x if q == 1 else filtered(x, own, q))(samples)


def interpolated(x: np.ndarray, p: int, length: int, squared: bool = False) -> np.ndarray:
    """``p`` values for each sample of the rows, cut to ``length``: low-passed as if p - 1 zeros followed each sample.

    Each of the p phases has its own taps, so no zero is multiplied. ``squared`` takes variances to variances.
    """
    taps, half = p * low_pass(p), 10
    at = np.arange(p)[None] + p * (half - np.arange(2 * half + 1))[:, None] + half * p
    own = np.where(at < len(taps), taps[np.minimum(at, len(taps) - 1)], 0.0)
    padded = np.pad(x, ((0, 0), (half, half)))
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=1)
    return (view @ (own**2 if squared else own)).reshape(len(x), -1)[:, :length]


@dataclass(frozen=True)
class Grid:
    """Cycles of ``length`` samples thinned by ``q``, for extractors that work on a few hundred samples, and the way back.

    Thinned samples share taps; their variances are carried, the covariances that this makes are not.
    """

    length: int
    q: int = 1

    @classmethod
    def of(cls, length: int, target: int = 500) -> Grid:
        return cls(length, factor(length, target))

    @property
    def size(self) -> int:
        return -(-self.length // self.q)

    def down(self, x: np.ndarray) -> np.ndarray:
        return x if self.q == 1 else filtered(x, low_pass(self.q), self.q)

    def down_variance(self, v: np.ndarray) -> np.ndarray:
        return v if self.q == 1 else filtered(v, low_pass(self.q) ** 2, self.q)

    def up(self, x: np.ndarray) -> np.ndarray:
        return x if self.q == 1 else interpolated(x, self.q, self.length)

    def up_variance(self, v: np.ndarray) -> np.ndarray:
        return v if self.q == 1 else interpolated(v, self.q, self.length, True)

    def samples(self, k: int) -> tuple[int, int]:
        """The first and last sample (from 1) for which thinned sample ``k`` (from 1) stands."""
        return (k - 1) * self.q + 1, min(k * self.q, self.length)


def mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def sinc_bank(n: int, taps: int, rate: float) -> np.ndarray:
    """Hamming-windowed band-pass filters between mel-spaced edges."""
    edges = 700 * (10 ** (np.linspace(mel(30.0 if rate > 60 else 0.0), mel(rate / 2), n + 1) / 2595) - 1)
    k = np.arange(taps) - (taps - 1) / 2
    low = lambda f: 2 * f / rate * np.sinc(2 * f / rate * k)
    bank = np.stack([low(b) - low(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]) * np.hamming(taps)
    return bank / np.abs(bank).sum(axis=1, keepdims=True)


def bank_energy(samples: Column, bank: np.ndarray) -> Column:
    """Mean squared output of each filter over the valid part of the convolution."""

    def run(x: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(x, bank.shape[1], axis=1)
        return ((view @ bank[:, ::-1].T) ** 2).mean(axis=1)

    return matrix_udf(run)(samples)
