"""Training stacks: extractors, prefilter, ranked features with a searched count, and a learner, fitted one after another.

A stack works on packed cycles (cycle_id, sensor, samples, u, target or y). Fitted extractors are narrow maps over
arrays, so applying a stack is one pass; uncertainties go along as a second array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import matrix_udf, pair_udf
from skein.functions.sums import strongest
from skein.operators import classify, evaluate, neighbours, piecewise, regress, search, segments, select, subspace, timefrequency, wavelet
from skein.operators.resample import Grid

Map = Callable[[np.ndarray], np.ndarray]


@dataclass
class Extractor:
    """Features of one sensor: a function of its samples, and what carries the samples' variances to theirs. Where the function
    isn't linear, that is by its derivatives at each row's own samples."""

    names: list[str]
    apply: Map
    variance: Callable[[np.ndarray, np.ndarray], np.ndarray]
    back: Map | None = None

    def features(self, samples: Column) -> Column:
        return matrix_udf(self.apply)(samples)

    def uncertainty(self, samples: Column, u: Column) -> Column:
        """Null elements where a feature has no derivative, as a phase of amplitude 0."""
        return pair_udf(lambda x, e: np.sqrt(self.variance(x, e * e)))(samples, u)

    def reconstruct(self, features: Column) -> Column:
        """Samples from features, at the cycle's own length, where the extractor has a way back."""
        if self.back is None:
            raise ValueError("these features don't draw a cycle")
        return matrix_udf(self.back)(features)


def _linear(names: list[str], w: np.ndarray, center: np.ndarray | float = 0.0, grid: Grid | None = None, back: np.ndarray | None = None) -> Extractor:
    """Weighted sums of the thinned samples; ``back`` has what each feature adds to them."""
    if grid is None:
        return Extractor(names, lambda x: (x - center) @ w, lambda _, v: v @ (w * w))
    return Extractor(names, lambda x: (grid.down(x) - center) @ w, lambda _, v: grid.down_variance(v) @ (w * w), None if back is None else lambda f: grid.up(f @ back + center))


def _thinned(cycles: DataFrame, target: int) -> tuple[Grid, DataFrame]:
    """The grid of cycles of one length (that of the first), and the cycles on it."""
    grid = Grid.of(cycles.select(F.size("samples").alias("n")).first().n, target)
    return grid, cycles if grid.q == 1 else cycles.withColumn("samples", matrix_udf(grid.down)(F.col("samples")))


def _segment_weights(bounds: list[tuple[int, int, int]], length: int) -> np.ndarray:
    """Weights of mean and slope of each segment."""
    w = np.zeros((length, 2 * len(bounds)))
    for k, a, b in bounds:
        t = np.arange(a, b + 1) - (a + b) / 2
        w[a - 1 : b, 2 * k - 2] = 1 / len(t)
        w[a - 1 : b, 2 * k - 1] = t / max((t * t).sum(), 1e-300)
    return w


def _lines(bounds: list[tuple[int, int, int]], length: int) -> np.ndarray:
    """What each mean and slope adds to the samples; a border is drawn by the later piece."""
    back = np.zeros((2 * len(bounds), length))
    for k, a, b in bounds:
        back[:, a - 1 : b] = 0
        back[2 * k - 2, a - 1 : b] = 1
        back[2 * k - 1, a - 1 : b] = np.arange(a, b + 1) - (a + b) / 2
    return back


def fit_piecewise(cycles: DataFrame, n: int | None = 12, target: int = 500) -> Extractor:
    """Means and slopes of the pieces; cycles of over ``target`` samples are thinned first, and slopes are those of thinned samples."""
    grid, thin = _thinned(cycles, target)
    sse = piecewise.error_matrix(piecewise.interval_errors(thin))
    bounds = piecewise.intervals(piecewise.splits_for(sse, n), len(sse))
    names = [f"{s}_{k}" for k, *_ in bounds for s in ("mean", "slope")]
    return _linear(names, _segment_weights(bounds, len(sse)), grid=grid, back=_lines(bounds, len(sse)))


def fit_principal(cycles: DataFrame, n: int | str | None = 10, target: int = 500) -> Extractor:
    """Scores of the components of cycles thinned to ``target`` samples: the first ``n``, all (None), a tenth of them
    (``percent``), or those up to the elbow of their shares of variance (``elbow``)."""
    grid, thin = _thinned(cycles, target)
    p = subspace.pca(subspace.moments(thin.select(F.col("samples").alias("features")))[()], n if isinstance(n, int) else None)
    count = {"percent": max(1, len(p.explained) // 10), "elbow": wavelet.elbow(list(p.explained))}[n] if isinstance(n, str) else p.vectors.shape[1]
    w = p.vectors[:, :count]
    return _linear([f"pc_{k + 1}" for k in range(count)], w, p.mean, grid, w.T)


def fit_identity(cycles: DataFrame, n: int | None = None) -> Extractor:
    """The samples themselves."""
    length = cycles.select(F.size("samples").alias("n")).first().n
    return Extractor([f"x_{k + 1}" for k in range(length)], lambda x: x, lambda _, v: v, lambda f: f)


def fit_wavelet(cycles: DataFrame, n: int | None = None) -> Extractor:
    length = cycles.select(F.size("samples").alias("n")).first().n
    at = sorted(strongest(cycles, wavelet.analyse, n))
    return _linear([f"w_{k + 1}" for k in at], wavelet.matrix(length)[at].T)


def fit_fourier(cycles: DataFrame, n: int | None = None) -> Extractor:
    """Amplitudes and phases of the bins of the largest mean amplitude."""
    at = sorted(strongest(cycles, lambda x: np.fft.fft(x, axis=1)[:, : x.shape[1] // 2], n))

    def run(x: np.ndarray) -> np.ndarray:
        z = np.fft.fft(x, axis=1)[:, at]
        return np.hstack([np.abs(z), np.angle(z)])

    def variance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        z = np.fft.fft(x, axis=1)[:, at]
        angle = 2 * np.pi * np.outer(np.arange(x.shape[1]), at) / x.shape[1]
        c, s = np.cos(angle), -np.sin(angle)
        rr, ri, ii = v @ (c * c), v @ (c * s), v @ (s * s)
        with np.errstate(divide="ignore", invalid="ignore"):
            re, im = z.real / np.abs(z), z.imag / np.abs(z)
            amplitude = re * re * rr + 2 * re * im * ri + im * im * ii
            phase = (im * im * rr - 2 * re * im * ri + re * re * ii) / np.abs(z) ** 2
        return np.maximum(np.hstack([amplitude, phase]), 0)

    return Extractor([f"{s}_{k}" for s in ("amplitude", "phase") for k in at], run, variance)


def fit_moments(cycles: DataFrame, n: int | None = 10) -> Extractor:
    length = cycles.select(F.size("samples").alias("n")).first().n
    bounds = [b for b in segments.tumbling(length, n or 10) if b[2] >= b[1]]

    def run(x: np.ndarray) -> np.ndarray:
        out = []
        for _, a, b in bounds:
            s = x[:, a - 1 : b]
            d = s - s.mean(axis=1, keepdims=True)
            m2 = (d * d).mean(axis=1)
            safe = np.where(m2 > 0, m2, 1)
            out += [s.mean(axis=1), np.sqrt(m2 * s.shape[1] / max(s.shape[1] - 1, 1)), (d**3).mean(axis=1) / safe**1.5, (d**4).mean(axis=1) / safe**2]
        return np.stack(out, axis=1)

    def variance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = []
        for _, a, b in bounds:
            e, n = v[:, a - 1 : b], b - a + 1
            d = x[:, a - 1 : b] - x[:, a - 1 : b].mean(axis=1, keepdims=True)
            m2, m3, m4 = ((d**p).mean(axis=1)[:, None] for p in (2, 3, 4))
            still = m2 <= 0
            m2 = np.where(still, 1, m2)
            slopes = [1 / n, d / ((n - 1) * np.sqrt(m2 * n / (n - 1))) if n > 1 else 0 * d, 3 / n * ((d * d - m2) / m2**1.5 - m3 * d / m2**2.5), 4 / n * ((d**3 - m3) / m2**2 - m4 * d / m2**3)]
            out += [(e * slopes[0] ** 2).sum(axis=1), *[np.where(still[:, 0], np.nan, (e * c * c).sum(axis=1)) for c in slopes[1:]]]
        return np.stack(out, axis=1)

    return Extractor([f"{s}_{k}" for k, *_ in bounds for s in segments.MOMENTS], run, variance)


def fit_time_frequency(cycles: DataFrame, n: int | None = 10) -> Extractor:
    """Nine statistics of ``n`` time segments and of as many bands of each one's spectrum. What a short band leaves undefined is 0."""
    length = cycles.select(F.size("samples").alias("n")).first().n
    tf = timefrequency.TimeFrequency(n or 10, n or 10)
    return Extractor(tf.names(length), lambda x: np.nan_to_num(tf.matrix(x)), lambda x, v: np.nan_to_num(tf.variances(x, v)))


EXTRACTORS: dict[str, Callable[..., Extractor]] = {"identity": fit_identity, "piecewise": fit_piecewise, "principal": fit_principal, "wavelet": fit_wavelet, "fourier": fit_fourier, "moments": fit_moments, "time-frequency": fit_time_frequency}


def _standard(rows: DataFrame, m: subspace.Moments) -> DataFrame:
    dev = np.sqrt(np.maximum(np.diag(m.scatter) / (m.n - 1), 0))
    scale, mean = np.where(dev > 0, dev, np.inf), m.mean
    return rows.withColumn("features", matrix_udf(lambda x: (x - mean) / scale)(F.col("features")))


@dataclass
class Prepared:
    """Features of all extractors with folds, and the statistics of each fold (and class, or with y as the last feature). Rank correlations
    of all features are taken at once, when they are first asked for."""

    rows: DataFrame
    y: str
    parts: dict[tuple, subspace.Moments]
    scores: dict[int, float] | None = None
    lock: Lock = field(default_factory=Lock, repr=False)

    @classmethod
    def of(cls, cycles: DataFrame, made: list[tuple[str, str, Extractor]], y: str, folds: int) -> Prepared:
        rows = extracted(cycles, made, (y,)).where(F.col(y).isNotNull())
        dealt = (evaluate.stratified_folds(rows, folds, target=y) if y == "target" else rows.withColumn("fold", (evaluate.fold_hash() % folds).cast("int"))).persist()
        return cls(dealt, y, subspace.moments(dealt, ("fold", "target")) if y == "target" else subspace.moments(dealt, ("fold",), also=("y",)))

    def by_class(self) -> dict[tuple, subspace.Moments]:
        return {(c,): search.total([m for k, m in self.parts.items() if k[1] == c]) for c in sorted({k[1] for k in self.parts})}

    def with_y(self) -> subspace.Moments:
        """Of all rows, y (a class as its number) being the last feature."""
        return search.total(list(self.parts.values()) if self.y == "y" else [m.with_constant(float(c)) for (c,), m in self.by_class().items()])

    def columns(self, at: list[int]) -> DataFrame:
        return self.rows.withColumn("features", F.array(*[F.get("features", F.lit(k)) for k in at]))

    def by_correlation(self, at: list[int]) -> list[int]:
        m = self.with_y()
        s = np.diag(m.scatter)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.nan_to_num(np.abs(m.scatter[at, -1]) / np.sqrt(s[at] * s[-1]))
        return [at[k] for k in np.argsort(-r, kind="stable")]

    def by_rank_correlation(self, at: list[int]) -> list[int]:
        with self.lock:
            if self.scores is None:
                self.scores = select.rank_correlations(self.rows, self.y)
        return [at[k] for k in np.argsort([-self.scores.get(k, 0.0) for k in at], kind="stable")]

    def by_relief(self, at: list[int]) -> list[int]:
        scores = neighbours.relief(_standard(self.columns(at), search.total(list(self.by_class().values())).of(at)))
        return [at[r.feature_idx - 1] for r in select.ranking(scores).orderBy("rank").collect()]

    def by_elimination(self, at: list[int]) -> list[int]:
        return [at[k] for k in classify.recursive_elimination({c: m.of(at) for c, m in self.by_class().items()})]


#: Rankers: of places of features, best first. By correlation and by elimination from the statistics alone.
RANKERS: dict[str, Callable[[Prepared, list[int]], list[int]]] = {
    "pearson": Prepared.by_correlation,
    "spearman": Prepared.by_rank_correlation,
    "relief": Prepared.by_relief,
    "elimination": Prepared.by_elimination,
}


@dataclass
class Stack:
    """What to fit: extractors for each sensor, the ranker, the learner (``lda``, ``lda-euclidean`` or ``pls``) and bounds of the search."""

    extractors: list[str]
    ranker: str = "pearson"
    learner: str = "lda"
    prefilter: int = 500
    most: int = 100
    folds: int = 10
    sizes: dict[str, int] = field(default_factory=dict)

    @property
    def y(self) -> str:
        return "y" if self.learner == "pls" else "target"

    @property
    def metric(self) -> str:
        return "euclidean" if self.learner.endswith("euclidean") else "mahalanobis"

    def parts(self) -> list[tuple[str, int | None]]:
        """(extractor, size) of each."""
        return [(e, self.sizes.get(e)) for e in self.extractors]

    def ranked(self, table: Prepared, at: list[int]) -> list[int]:
        first = RANKERS["spearman" if self.ranker == "spearman" else "pearson"](table, at)[: self.prefilter]
        return first if self.ranker in ("pearson", "spearman") else RANKERS[self.ranker](table, first)

    def model(self, table: Prepared, at: list[int]) -> subspace.Discriminant | regress.Linear:
        if self.y == "y":
            m = table.with_y()
            return regress.pls(m.of([*at, len(m.mean) - 1]))
        return subspace.lda({c: m.of(at) for c, m in table.by_class().items()}, self.metric)

    def fit(self, cycles: DataFrame) -> FittedStack:
        """Extractors, then one pass for the statistics of folds and, for classes, one that counts errors of all feature counts."""
        made = fitted(cycles, self.parts())
        table = Prepared.of(cycles, made, self.y, self.folds)
        rank = self.ranked(table, list(range(sum(len(x.names) for *_, x in made))))
        losses = search.regression_losses(None, rank, self.most, parts=table.parts) if self.y == "y" else search.classification_losses(table.rows, rank, self.most, self.metric, parts=table.parts)
        count, loss = search.best(losses)
        model = self.model(table, rank[:count])
        table.rows.unpersist()
        return FittedStack(made, rank[:count], model, losses, loss)


def fitted(cycles: DataFrame, parts: list[tuple[str, int | None]]) -> list[tuple[str, str, Extractor]]:
    """(sensor, extractor, fitted) of each part and sensor."""
    sensors = sorted(r[0] for r in cycles.select("sensor").distinct().collect())
    return [(s, e, EXTRACTORS[e](cycles.where(F.col("sensor") == s), *([] if n is None else [n]))) for e, n in parts for s in sensors]


@dataclass
class FittedStack:
    made: list[tuple[str, str, Extractor]]
    at: list[int]
    model: subspace.Discriminant | regress.Linear
    losses: list[tuple[int, float]]
    loss: float

    def transform(self, cycles: DataFrame) -> DataFrame:
        """(cycle_id, prediction)."""
        rows = extracted(cycles, self.made)
        return rows.select("cycle_id", self.model.predict(F.array(*[F.get("features", F.lit(k)) for k in self.at])).alias("prediction"))

    def propagate(self, cycles: DataFrame) -> DataFrame:
        """(cycle_id, prediction and its uncertainty, or the least and greatest class of the error box), the latter by the derivatives of all extractors."""
        rows = extracted(cycles, self.made, uncertainty=True)
        x, u = (F.array(*[F.get(c, F.lit(k)) for k in self.at]) for c in ("features", "u_features"))
        if isinstance(self.model, regress.Linear):
            return rows.select("cycle_id", self.model.predict(x).alias("prediction"), self.model.uncertainty(u).alias("u"))
        low, high = self.model.interval(x, u)
        return rows.select("cycle_id", self.model.predict(x).alias("prediction"), low.alias("min_pred"), high.alias("max_pred"))

    def provenance(self) -> list[tuple[int, str, str, str]]:
        """(place, sensor, extractor, feature name) of the chosen features."""
        names = [(s, e, n) for s, e, x in self.made for n in x.names]
        return [(k + 1, *names[i]) for k, i in enumerate(self.at)]


def extracted(cycles: DataFrame, made: list[tuple[str, str, Extractor]], keep: tuple[str, ...] = (), uncertainty: bool = False) -> DataFrame:
    """(cycle_id, keep, features[, u_features]): the blocks of all extractors side by side, by one grouping of the sensors of a cycle."""
    wide = cycles.groupBy("cycle_id", *keep).pivot("sensor", sorted({s for s, *_ in made})).agg(F.first(F.struct("samples", *["u"] * uncertainty)))
    columns = [F.concat(*[x.features(F.col(s)["samples"]) for s, _, x in made]).alias("features")]
    if uncertainty:
        columns.append(F.concat(*[x.uncertainty(F.col(s)["samples"], F.col(s)["u"]) for s, _, x in made]).alias("u_features"))
    return wide.select("cycle_id", *keep, *columns)


#: The extractors of the named stacks.
BASE = ("piecewise", "principal", "wavelet", "fourier", "moments")
#: Named stacks: each extractor with each ranker before LDA, each extractor with each ranker before PLS, and all extractors at once.
PRESETS: dict[str, Stack] = {f"{e}-{r}-lda": Stack([e], r) for e in BASE for r in ("pearson", "relief", "elimination")}
PRESETS |= {f"{e}-{r}-pls": Stack([e], r, "pls") for e in BASE for r in ("pearson", "spearman")}
PRESETS |= {"all-pearson-lda": Stack(list(BASE)), "all-pearson-pls": Stack(list(BASE), learner="pls")}
