"""Novelty scores with thresholds. ``higher_is_novel`` goes with each detector, so decisions follow the score's direction."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import matrix_udf
from skein.functions.sums import added
from skein.operators.regress import FourierFeatures
from skein.operators.subspace import Moments, Projection, moments, pca


def decided(rows: DataFrame, threshold: float, higher_is_novel: bool, score: str = "score") -> DataFrame:
    novel = F.col(score) > threshold if higher_is_novel else F.col(score) < threshold
    return rows.withColumn("threshold", F.lit(threshold)).withColumn("is_novel", novel)


@dataclass
class Mixture:
    """Gaussians with one diagonal covariance; score = density (low is novel)."""

    weights: np.ndarray
    means: np.ndarray
    variance: np.ndarray
    higher_is_novel = False

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - self.means[None]) ** 2 / self.variance).sum(axis=2)
        return np.log(self.weights) - 0.5 * (d + np.log(2 * np.pi * self.variance).sum())

    def score(self, features: Column) -> Column:
        def run(x: np.ndarray) -> np.ndarray:
            z = self.log_parts(x)
            top = z.max(axis=1, keepdims=True)
            return np.exp(top + np.log(np.exp(z - top).sum(axis=1, keepdims=True)))

        return F.get(matrix_udf(run)(features), F.lit(0))


def mixture(packed: DataFrame, k: int | None = None, iterations: int = 200, floor: float = 0.01, seed: int = 5) -> Mixture:
    """Expectation maximisation: each round is one pass that sums responsibilities, weighted rows and squares; the state is k by features. Without ``k`` the gap statistic chooses it.

    Sums are around the rows' mean, so large means keep their small deviations.
    """
    rows = packed.where(F.col("features").isNotNull())
    m = moments(rows)[()]
    k = gap_statistic(rows, seed=seed).k if k is None else k
    rng = np.random.default_rng(seed)
    spread = np.sqrt(np.diag(m.scatter) / m.n)
    model = Mixture(np.full(k, 1 / k), m.mean + rng.normal(0, 1, (k, len(m.mean))) * spread, np.diag(m.scatter) / m.n + floor)
    last = None
    for _ in range(iterations):

        def one(batch: pd.DataFrame, model: Mixture = model) -> dict[int, np.ndarray]:
            x = np.stack(batch["features"].to_numpy()).astype(float)
            z = model.log_parts(x)
            top = z.max(axis=1, keepdims=True)
            total = top + np.log(np.exp(z - top).sum(axis=1, keepdims=True))
            r, d = np.exp(z - total), x - m.mean
            return {0: np.concatenate([[total.sum()], r.sum(axis=0), (r.T @ d).ravel(), (r.sum(axis=1) @ (d * d))])}

        sums = added(rows.select("features"), one)[0]
        n, s, q = sums[1 : k + 1], sums[k + 1 : -len(m.mean)].reshape(k, -1), sums[-len(m.mean) :]
        means = s / np.maximum(n, 1e-12)[:, None]
        variance = np.maximum((q - (n[:, None] * means**2).sum(axis=0)) / n.sum(), 0) + floor
        model = Mixture(np.maximum(n / n.sum(), 1e-12), m.mean + means, variance)
        if last is not None and abs(sums[0] - last) < 1e-6 * abs(last):
            break
        last = sums[0]
    return model


@dataclass
class Gap:
    """By number of clusters from 1: expected less observed log dispersion, and its standard error; ``k`` is the number chosen."""

    gaps: np.ndarray
    errors: np.ndarray
    dispersion: np.ndarray
    k: int


def _uniform(keys: np.ndarray, which: int, dim: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row's key, so a row draws the same in every pass and task."""
    start = int(np.random.default_rng([seed, which]).integers(0, 1 << 63))
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start) + np.arange(1, dim + 1, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def _spread_out(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows of a sample, each likelier the farther it is from those before."""
    at = [int(rng.integers(len(sample)))]
    near = ((sample - sample[at[0]]) ** 2).sum(axis=1)
    while len(at) < k:
        at.append(int(rng.choice(len(sample), p=near / near.sum())) if near.sum() > 0 else int(rng.integers(len(sample))))
        near = np.minimum(near, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def gap_statistic(packed: DataFrame, most: int = 50, references: int = 10, rounds: int = 15, sample: int = 2000, seed: int = 5) -> Gap:
    """How many clusters: of 1 to ``most`` the fewest whose gap is within a standard error of the largest gap.

    k-means of every number of clusters, on the rows and on ``references`` uniform tables in the rows' box, all share their passes:
    ``rounds`` in all. A reference row is drawn where its row is read, from a hash of the row, so no table is made or moved. Starts are
    spread out over at most ``sample`` rows; everything else is over all rows. Numbers beyond that of the rows are left out.
    """
    rows = packed.where(F.col("features").isNotNull()).select("features", F.xxhash64(*[c for c in packed.columns if c in ("cycle_id", "features")]).alias("key"))
    ends = rows.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    low, high, mean = (np.array([r[c] for r in ends]) for c in ("low", "high", "mean"))
    dim, most = len(low), min(most, ends[0]["n"])
    rng = np.random.default_rng(seed)
    first = np.array([r[0] for r in rows.orderBy("key").limit(sample).select("features").collect()]) - mean
    counts = np.arange(1, most + 1)
    starts = np.concatenate([[0], np.cumsum(counts)])

    def table(batch: pd.DataFrame, b: int) -> np.ndarray:
        if b == 0:
            return np.stack(batch["features"].to_numpy()).astype(float) - mean
        return low + (high - low) * _uniform(batch["key"].to_numpy(), b, dim, seed) - mean

    centres = [np.concatenate([_spread_out(first if b == 0 else low + (high - low) * rng.random((min(sample, 50 * most), dim)) - mean, int(k), rng) for k in counts]) for b in range(references + 1)]
    for _ in range(rounds):
        now = centres

        def one(batch: pd.DataFrame, now: list[np.ndarray] = now) -> dict[int, np.ndarray]:
            out = {}
            for b, c in enumerate(now):
                x = table(batch, b)
                own = (x * x).sum(axis=1)
                d = np.maximum(own[:, None] + (c * c).sum(axis=1)[None] - 2 * x @ c.T, 0)
                sums, weight = np.zeros((len(c), dim + 1)), np.zeros(most)
                for k, (at, end) in enumerate(pairwise(starts)):
                    best = d[:, at:end].argmin(axis=1)
                    hot = np.zeros((len(x), end - at))
                    hot[np.arange(len(x)), best] = 1
                    sums[at:end, :dim], sums[at:end, dim] = hot.T @ x, hot.sum(axis=0)
                    weight[k] = d[np.arange(len(x)), at + best].sum()
                out[b] = np.concatenate([weight, sums.ravel()])
            return out

        found = added(rows, one)
        dispersion = np.stack([found[b][:most] for b in range(references + 1)])
        centres = []
        for b, c in enumerate(now):
            sums = found[b][most:].reshape(len(c), -1)
            centres.append(np.where(sums[:, dim:] > 0, sums[:, :dim] / np.maximum(sums[:, dim:], 1), c))
    logs = np.log(np.maximum(dispersion, 1e-300))
    gaps = logs[1:].mean(axis=0) - logs[0]
    errors = logs[1:].std(axis=0) * np.sqrt(1 + 1 / references)
    top = int(gaps.argmax())
    return Gap(gaps, errors, dispersion[0], int(np.flatnonzero(gaps >= gaps[top] - errors[top])[0]) + 1)


def low_threshold(scores: DataFrame, score: str = "score") -> float:
    """Mean less three deviations of the training scores."""
    return scores.agg(F.avg(score) - 3 * F.stddev_samp(score)).first()[0]


@dataclass
class OneClass:
    """Similarity to the training rows' mean in random Fourier features: a one-class kernel machine with equal weights; below 0 is novel."""

    features: FourierFeatures
    center: np.ndarray
    offset: float
    higher_is_novel = False

    def score(self, features: Column) -> Column:
        c, b = self.center, self.offset
        return F.get(matrix_udf(lambda z: (z @ c - b)[:, None])(self.features(features)), F.lit(0))


def one_class(packed: DataFrame, share: float = 0.05, size: int = 128) -> OneClass:
    """``share`` of the training rows lies beyond the offset."""
    rff = FourierFeatures.of(moments(packed)[()], size)
    center = moments(packed.select(rff(F.col("features")).alias("features")))[()].mean
    model = OneClass(rff, center, 0.0)
    offset = packed.select(model.score(F.col("features")).alias("s")).agg(F.percentile_approx("s", share)).first()[0]
    return OneClass(rff, center, offset)


@dataclass
class AutoEncoder:
    """The linear auto-encoder, whose optimum is the principal subspace; score = reconstruction error (high is novel)."""

    p: Projection
    higher_is_novel = True

    def score(self, features: Column) -> Column:
        w, mean = self.p.vectors, self.p.mean

        def run(x: np.ndarray) -> np.ndarray:
            d = x - mean
            return np.sqrt(((d - d @ w @ w.T) ** 2).sum(axis=1, keepdims=True))

        return F.get(matrix_udf(run)(features), F.lit(0))


def auto_encoder(m: Moments, hidden: int | None = None) -> AutoEncoder:
    return AutoEncoder(pca(m, hidden or int(np.ceil(m.n**0.05))))
