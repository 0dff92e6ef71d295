"""One-pass sufficient statistics of feature matrices, and what follows from them: PCA, LDA, projections.

Statistics of a group are its count, mean and centred products. They merge and part, so folds, classes and tasks combine, and
the statistics of the first features of a ranking are a sub-matrix. ``gram`` has plain sums of products for streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import matrix_udf


def gram(packed: DataFrame, by: tuple[str, ...] = (), column: str = "features", also: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, value): sums of products of [1, features, also]; i <= j count from 0. Each batch adds up its own before the shuffle."""
    keys = [f"`{b}` {packed.schema[b].dataType.simpleString()}" for b in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch[column].notna()]
            for key, part in batch.groupby(list(by), dropna=False) if by else [((), batch)]:
                if not len(part):
                    continue
                x = np.hstack([np.ones((len(part), 1)), np.stack(part[column].to_numpy()), *[part[[c]].to_numpy(float) for c in also]])
                g = x.T @ x
                i, j = np.triu_indices(len(g))
                yield pd.DataFrame(dict(zip(by, key if isinstance(key, tuple) else (key,), strict=True)) | {"i": i, "j": j, "value": g[i, j]})

    rows = packed.select(*by, column, *also).mapInPandas(run, ", ".join([*keys, "i int", "j int", "value double"]))
    return rows.groupBy(*by, "i", "j").agg(F.sum("value").alias("value"))


@dataclass
class Moments:
    """n, mean and centred sums of squares and products; groups merge and part without ever squaring what isn't centred."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of_rows(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        d = x - mean
        rest = d.mean(axis=0)
        return cls(float(len(x)), mean + rest, d.T @ d - len(x) * np.outer(rest, rest))

    def __add__(self, other: Moments) -> Moments:
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))

    def __sub__(self, other: Moments) -> Moments:
        n = self.n - other.n
        if n <= 0:
            return Moments(0.0, np.zeros_like(self.mean), np.zeros_like(self.scatter))
        d = self.mean - other.mean
        return Moments(n, self.mean + d * (other.n / n), self.scatter - other.scatter - np.outer(d, d) * (self.n * other.n / n))

    def of(self, features: list[int]) -> Moments:
        """Of some features (from 0), in their order."""
        return Moments(self.n, self.mean[features], self.scatter[np.ix_(features, features)])

    def scaled(self, center: np.ndarray, scale: np.ndarray) -> Moments:
        """Of (x - center) * scale."""
        return Moments(self.n, (self.mean - center) * scale, self.scatter * np.outer(scale, scale))

    def with_constant(self, y: float) -> Moments:
        """Of [x, y] for a y that all rows share."""
        return Moments(self.n, np.append(self.mean, y), np.pad(self.scatter, (0, 1)))

    def squares(self, intercept: float, beta: np.ndarray) -> float:
        """The sum of (y - intercept - x beta)^2, y being the last feature."""
        v = np.append(-beta, 1.0)
        return float(v @ self.scatter @ v + self.n * (v @ self.mean - intercept) ** 2)


#: Rows of tasks merge by this many slots of a group first, then the slots.
SLOTS = 32


def moments(packed: DataFrame, by: tuple[str, ...] = (), column: str = "features", also: tuple[str, ...] = ()) -> dict[tuple, Moments]:
    """The statistics of each group, on the driver: their size is groups times squared features, whatever the rows.

    Each task sends one row a group: its own mean and sums around it. Rows without features are left out.
    """
    keys = [f"`{b}` {packed.schema[b].dataType.simpleString()}" for b in by]
    kind = ", ".join([*keys, "_slot int", "_n double", "_mean array<double>", "_s array<double>"])

    def frame(held: dict[tuple, Moments], slot: int) -> pd.DataFrame:
        rows = [(*key, slot, m.n, m.mean, m.scatter.ravel()) for key, m in held.items()]
        return pd.DataFrame(rows, columns=[*by, "_slot", "_n", "_mean", "_s"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            batch = batch[batch[column].notna()]
            for key, part in batch.groupby(list(by), dropna=False) if by else [((), batch)]:
                if len(part):
                    own = Moments.of_rows(np.hstack([np.stack(part[column].to_numpy()).astype(float), *[part[[c]].to_numpy(float) for c in also]]))
                    key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                    held[key] = held[key] + own if key in held else own
        yield frame(held, (TaskContext.get().partitionId() if TaskContext.get() else 0) % SLOTS)

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, mean, scatter in zip(part["_n"], part["_mean"], part["_s"], strict=True):
            own = Moments(n, np.asarray(mean), np.asarray(scatter).reshape(len(mean), -1))
            total = own if total is None else total + own
        out = part.iloc[:1].copy()
        out["_n"], out["_mean"], out["_s"] = total.n, [total.mean], [total.scatter.ravel()]
        return out

    rows = packed.select(*by, column, *also).mapInPandas(first, kind)
    slots = rows.groupBy(*by, "_slot").applyInPandas(merged, kind)
    found = (slots.withColumn("_slot", F.lit(0)).groupBy(*by, "_slot").applyInPandas(merged, kind)).collect()
    return {tuple(r[b] for b in by): Moments(r["_n"], np.array(r["_mean"]), np.array(r["_s"]).reshape(len(r["_mean"]), -1)) for r in found}


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


@dataclass
class Projection:
    """(x - mean) / scale times ``vectors`` (features by components)."""

    mean: np.ndarray
    scale: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def _matrix(self) -> np.ndarray:
        return self.vectors / self.scale[:, None]

    def scores(self, features: Column) -> Column:
        w, mean = self._matrix(), self.mean
        return matrix_udf(lambda x: (x - mean) @ w)(features)

    def uncertainty(self, u: Column) -> Column:
        w = self._matrix() ** 2
        return matrix_udf(lambda x: np.sqrt((x * x) @ w))(u)

    def reconstruct(self, scores: Column) -> Column:
        back, mean, scale = self.vectors.T, self.mean, self.scale
        return matrix_udf(lambda s: s @ back * scale + mean)(scores)


def pca(m: Moments, k: int | None = None, standardise: bool = False, center: bool = True) -> Projection:
    """Principal components by eigenvalue; ``standardise`` divides by deviations (constant columns get no weight)."""
    cov = m.scatter / (m.n - 1)
    dev = np.sqrt(np.diag(cov))
    scale = np.where(dev > 0, dev, np.inf) if standardise else np.ones(len(dev))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values)[:k]
    return Projection(m.mean if center else np.zeros(len(dev)), scale, signed(vectors[:, order]), values[order] / values.sum())


@dataclass
class Discriminant:
    """Linear discriminant projection with class means (and inverse covariances) in it."""

    classes: list
    kept: np.ndarray
    vectors: np.ndarray
    means: np.ndarray
    inverses: np.ndarray
    majority: int

    def distances(self, x: np.ndarray) -> np.ndarray:
        p = x[:, self.kept] @ self.vectors
        d = p[:, None, :] - self.means[None]
        return np.einsum("ngi,gij,ngj->ng", d, self.inverses, d)

    def predict(self, features: Column) -> Column:
        """The class of the smallest distance, the first of ties; where none is finite, the majority class."""

        def run(x: np.ndarray) -> np.ndarray:
            d = self.distances(x)
            ok = np.isfinite(d).all(axis=1)
            return np.where(ok, np.where(np.isfinite(d), d, np.inf).argmin(axis=1), self.majority)[:, None].astype(float)

        return _label(F.get(matrix_udf(run)(features), F.lit(0)), self.classes)

    def project(self, features: Column) -> Column:
        kept, w = self.kept, self.vectors
        return matrix_udf(lambda x: x[:, kept] @ w)(features)

    def projected_uncertainty(self, u: Column) -> Column:
        kept, w = self.kept, self.vectors**2
        return matrix_udf(lambda x: np.sqrt(x[:, kept] ** 2 @ w))(u)

    def interval(self, features: Column, u: Column, most: int = 12) -> tuple[Column, Column]:
        """Least and greatest class (by order) at the corners of the error box in the projection."""
        d = self.vectors.shape[1]
        if d > most:
            raise ValueError(f"{2**d} corners")
        corners = np.array([[1 if k >> b & 1 else -1 for b in range(d)] for k in range(1 << d)], float)

        def run(both: np.ndarray) -> np.ndarray:
            n = both.shape[1] // 2
            x, e = both[:, :n][:, self.kept] @ self.vectors, np.sqrt(both[:, n:][:, self.kept] ** 2 @ self.vectors**2)
            at = x[:, None, :] + corners[None] * e[:, None, :]
            diff = at[:, :, None, :] - self.means[None, None]
            best = np.einsum("ncgi,gij,ncgj->ncg", diff, self.inverses, diff).argmin(axis=2)
            return np.stack([best.min(axis=1), best.max(axis=1)], axis=1).astype(float)

        both = matrix_udf(run)(F.concat(features, u))
        return _label(F.get(both, F.lit(0)), self.classes), _label(F.get(both, F.lit(1)), self.classes)


def _label(index: Column, classes: list) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


def lda(by_class: dict[tuple, Moments], metric: str = "mahalanobis") -> Discriminant:
    """Constant features dropped; eigenvectors of within^-1 between by eigenvalue, scaled to unit within-variance."""
    names = sorted(by_class)
    total = sum((by_class[c] for c in names[1:]), by_class[names[0]])
    kept = np.flatnonzero(np.diag(total.scatter) > 1e-12 * np.maximum(1, total.mean**2) * total.n)
    parts = [by_class[c].of(kept.tolist()) for c in names]
    majority = int(np.argmax([p.n for p in parts]))
    if not len(kept):  # nothing to tell classes by: the largest one is nearest
        return Discriminant([c[0] for c in names], kept, np.zeros((0, 1)), (np.arange(len(names)) != majority).astype(float)[:, None], np.ones((len(names), 1, 1)), majority)
    within = sum(p.scatter for p in parts)
    mean = total.of(kept.tolist()).mean
    between = sum(p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
    d = min(len(kept), len(names) - 1)
    root = np.linalg.cholesky(within + 1e-10 * np.trace(within) / len(kept) * np.eye(len(kept)))
    values, vectors = np.linalg.eigh(np.linalg.solve(root, np.linalg.solve(root, between).T))
    w = signed(np.linalg.solve(root.T, vectors[:, np.argsort(-values)[:d]]))
    w = w / np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", w, within, w), 1e-300) / max(total.n - len(names), 1))
    means = np.stack([p.mean @ w for p in parts])
    if metric == "euclidean":
        inverses = np.stack([np.eye(d)] * len(parts))
    else:
        inverses = np.stack([np.linalg.pinv(w.T @ p.scatter @ w / max(p.n - 1, 1)) for p in parts])
    return Discriminant([c[0] for c in names], kept, w, means, inverses, majority)
