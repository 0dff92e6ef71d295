"""Feature ranking. Scores are (feature_idx, score), bigger is better; features are long rows (cycle_id, feature_idx, v, u, target)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import order


def long_features(packed: DataFrame, share: float = 0.02, keep: tuple[str, ...] = ("cycle_id", "target")) -> DataFrame:
    rows = packed.select(*keep, F.posexplode("features").alias("_k", "v"))
    return rows.select(*keep, (F.col("_k") + 1).alias("feature_idx"), "v", (F.abs("v") * share + 0.001).alias("u"))


def ranking(scores: DataFrame) -> DataFrame:
    """(feature_idx, score, rank): ties to the lower index. One row per feature, so one partition orders them."""
    return scores.select("feature_idx", F.coalesce("score", F.lit(0.0)).alias("score")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature_idx")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate of the rows that have both; null where a side is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def pearson(long: DataFrame, target: str = "target", undefined: float = 0.0) -> DataFrame:
    """``undefined`` is the score where a side is constant; 0 where no row has both sides."""
    v, y = F.col("v"), F.col(target).cast("double")
    known = F.when(F.count(F.when(v.isNotNull() & y.isNotNull(), 1)) > 0, F.lit(undefined))
    return long.groupBy("feature_idx").agg(F.coalesce(F.abs(correlation(v, y)), known, F.lit(0.0)).alias("score"))


def mid_ranks(rows: DataFrame, column: str, name: str, by: tuple[str, ...] = ("feature_idx",)) -> DataFrame:
    """``rows`` with ``name``: their ranks by ``column`` in each group, from 1, ties averaged, nulls first and tied with each other.

    Rows are counted by value before any are ordered, so only distinct values are.
    """
    counts = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    places = order.running(counts, (column,), ("_n",), by)
    return order.beside(rows, places, (*by, column), "_n", **{name: F.col("_n_before") + (F.col("_n") + 1) / 2.0})


def ranked(long: DataFrame, target: str = "target") -> DataFrame:
    """``v`` and the target replaced by their mid-ranks in each feature."""
    out = mid_ranks(mid_ranks(long, "v", "_v"), target, "_y")
    return out.drop("v", target).withColumnsRenamed({"_v": "v", "_y": target})


def spearman(long: DataFrame, target: str = "target") -> DataFrame:
    return pearson(ranked(long, target), target)


def rank_correlations(packed: DataFrame, target: str = "target", column: str = "features") -> dict[int, float]:
    """By feature (from 0) the score that ``spearman`` gives packed rows of the same features each; rows without features are left out.

    The target is ranked once for all features. Rows are added up by feature and value before places are given, and no place is
    joined back; the driver gets one row a feature. Sums of squares of mid-ranks follow from the ties alone.
    """
    spread = lambda n, ties: (n**3 - n - ties) / 12
    ties = lambda c: F.sum(F.pow(F.col(c).cast("double"), 3) - F.col(c))
    packed = packed.where(F.col(column).isNotNull())
    n, y_ties = packed.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), ties("_n")).first()
    if not n:
        return {}
    middle = (n + 1) / 2.0
    rows = mid_ranks(packed.select(target, column), target, "_y", ()).select((F.col("_y") - middle).alias("_y"), F.posexplode(column).alias("_k", "_v"))
    counts = rows.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"))
    own = F.col("_n_before") + (F.col("_n") + 1) / 2.0 - middle
    found = order.running(counts, ("_v",), ("_n",), ("_k",)).groupBy("_k").agg(F.sum(own * F.col("_s")).alias("xy"), ties("_n").alias("ties")).collect()
    sizes = {r["_k"]: spread(float(n), r["ties"]) * spread(float(n), y_ties) for r in found}
    return {r["_k"]: abs(r["xy"]) / math.sqrt(sizes[r["_k"]]) if sizes[r["_k"]] > 0 else 0.0 for r in found}


def _beside(long: DataFrame, **of: Column) -> DataFrame:
    """``long`` with aggregates of each feature beside its rows. The broadcast has a row per feature, as many as one row's array holds."""
    return long.join(F.broadcast(long.groupBy("feature_idx").agg(*[c.alias(name) for name, c in of.items()])), "feature_idx")


def weighted_pearson(long: DataFrame, target: str = "target", formula: str = "proper") -> DataFrame:
    """``proper``: weights 1/u^2 and weighted means. ``reference``: weights u (1 where a feature's are all 0), means of w*x and w*y over n."""
    rows = long.select("feature_idx", "v", "u", F.col(target).cast("double").alias("y"))
    if formula == "proper":
        rows = rows.withColumn("w", F.try_divide(F.lit(1.0), F.col("u") * F.col("u")))
        mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
        rows = _beside(rows, mx=mean("v"), my=mean("y"))
        w, dx, dy = F.col("w"), F.col("v") - F.col("mx"), F.col("y") - F.col("my")
        sxy, sxx, syy = F.sum(w * dx * dy), F.sum(w * dx * dx), F.sum(w * dy * dy)
    else:
        rows = _beside(rows, most=F.max(F.abs("u")))
        rows = rows.select("feature_idx", "v", "y", F.when(F.col("most") == 0, 1.0).otherwise(F.col("u")).alias("w"))
        rows = _beside(rows, mx=F.avg(F.col("w") * F.col("v")), my=F.avg(F.col("w") * F.col("y")))
        w, dx, dy = F.col("w"), F.col("v") - F.col("mx"), F.col("y") - F.col("my")
        sxy, sxx, syy = F.sum((w * F.col("v") - F.col("mx")) * dy), F.sum(w * dx * dx), F.sum(w * dy * dy)
    return rows.groupBy("feature_idx").agg(F.coalesce(F.abs(F.try_divide(sxy, F.sqrt(sxx * syy))), F.lit(0.0)).alias("score"))


def weighted_spearman(long: DataFrame, target: str = "target", formula: str = "proper") -> DataFrame:
    return weighted_pearson(ranked(long, target), target, formula)


def zscore(long: DataFrame, column: str = "v") -> DataFrame:
    """Columns of mean 0 and sample deviation 1; a constant column becomes 0."""
    rows = _beside(long, _mean=F.avg(column), _dev=F.stddev_samp(column))
    scaled = F.coalesce(F.try_divide(F.col(column) - F.col("_mean"), F.col("_dev")), F.lit(0.0))
    return rows.withColumn(column, scaled).select(*long.columns)


def chi_squared(long: DataFrame, with_uncertainty: bool = False) -> DataFrame:
    """Sum over classes of ((O - E)/U)^2 / E of non-negative features, O a class's sum and E its share of the total by class size."""
    unit = F.sqrt(F.sum(F.col("u") * F.col("u"))) if with_uncertainty else F.lit(1.0)
    of = long.groupBy("feature_idx", "target").agg(F.sum("v").alias("o"), F.count(F.lit(1)).alias("n"), unit.alias("unit"))
    whole = Window.partitionBy("feature_idx")
    e = F.col("n") * F.sum("o").over(whole) / F.sum("n").over(whole)
    return of.withColumn("e", e).groupBy("feature_idx").agg(F.sum(F.try_divide(F.pow((F.col("o") - F.col("e")) / F.col("unit"), 2), F.col("e"))).alias("score"))


def project(packed: DataFrame, rank: list[int], n: int = 500, column: str = "features") -> DataFrame:
    """The first ``n`` ranked features in the order of their ranks."""
    chosen = rank[: min(n, len(rank))]
    return packed.withColumn(column, F.array(*[F.get(F.col(column), F.lit(k - 1)) for k in chosen]))
