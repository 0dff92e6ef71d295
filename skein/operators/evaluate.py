"""Folds, losses, score histograms and ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import order
from skein.operators.select import correlation, mid_ranks

#: A multiplicative hash of ids that any SQL engine can state.
FOLD_PRIME, FOLD_MODULUS = 7919, 10007


def fold_hash(id_col: str = "cycle_id") -> Column:
    return (F.col(id_col) * FOLD_PRIME) % FOLD_MODULUS


def stratified_folds(rows: DataFrame, k: int = 10, id_col: str = "cycle_id", target: str = "target") -> DataFrame:
    """Adds ``fold``: the ids of each class dealt in turn in the order of a hash of them. Rows of one id and class share a fold; a null class is a class."""
    ids = rows.groupBy(target, id_col).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_hash": fold_hash(id_col), "_one": F.lit(1).cast("long")})
    places = order.running(ids, ("_hash", id_col), ("_one",), (target,))
    return order.beside(rows, places, (target, id_col), "_n", fold=(F.col("_one_before") % k).cast("int"))


def group_folds(rows: DataFrame, group: str) -> DataFrame:
    """Adds ``fold`` from 1: one per distinct value of ``group``, in its order (null, where there is one, is the first). The distinct values are numbered, not the rows."""
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1).cast("long"))
    places = order.running(groups, (group,), ("_one",))
    return order.beside(rows, places, (group,), "_n", fold=(F.col("_one_before") + 1).cast("int"))


def classification_error(pred: str = "prediction", target: str = "target") -> Column:
    return 100.0 * F.avg((~F.col(pred).eqNullSafe(F.col(target))).cast("double"))


def rmse(pred: str = "prediction", target: str = "target") -> Column:
    d = F.col(pred) - F.col(target)
    return F.sqrt(F.avg(d * d))


def worst_case_rmse(pred: str = "prediction", target: str = "target", u: str = "u") -> Column:
    d = F.col(pred) - F.col(target)
    worst = F.greatest(F.abs(d + F.col(u)), F.abs(d - F.col(u)))
    return F.sqrt(F.avg(worst * worst))


def spearman_loss(rows: DataFrame, pred: str = "prediction", target: str = "target", by: tuple[str, ...] = ()) -> DataFrame:
    """1 - |rank correlation| of all rows, or of each group ``by``."""
    r = mid_ranks(mid_ranks(rows, pred, "_p", by), target, "_t", by)
    return r.groupBy(*by).agg((1 - F.abs(correlation(F.col("_p"), F.col("_t")))).alias("loss"))


def histogram(rows: DataFrame, score: str = "score", label: str = "normal", n: int = 50) -> DataFrame:
    """(bin from 1, label, n): bins of equal width shared by both labels, the maximum in the last."""
    ends = rows.agg(F.min(score).alias("_a"), F.max(score).alias("_b"))
    place = F.least(F.lit(n), F.floor(F.coalesce(F.try_divide((F.col(score) - F.col("_a")) * n, F.col("_b") - F.col("_a")), F.lit(0.0))).cast("int") + 1)
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin"), label).agg(F.count(F.lit(1)).alias("n"))


def roc(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(threshold, fpr, tpr, n, p, p_above); ``positive`` rows should score high. ``n`` and ``p`` count the negative and positive rows of just this score, ``p_above`` the positive ones of higher scores.

    Rows are counted by distinct score; those counts are added up along ranges of scores. A null score is below all others.
    """
    steps = rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    below = order.running(steps, ("threshold",), ("p", "n"))
    total = below.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    reached = lambda c: F.lit(total[c]).cast("long") - F.col(f"{c}_before")
    rate = lambda c: F.try_divide(reached(c), F.lit(total[c]).cast("long"))
    return below.select("threshold", rate("n").alias("fpr"), rate("p").alias("tpr"), "n", "p", (reached("p") - F.col("p")).alias("p_above"))


def auc(curve: DataFrame) -> DataFrame:
    """(auc, best_threshold) of a curve of ``roc``: trapezoids, added up as whole numbers, and the threshold of the largest tpr - fpr (the highest of ties)."""
    twice = F.sum(F.col("n").cast("decimal(18,0)") * (2 * F.col("p_above") + F.col("p")).cast("decimal(19,0)")).cast("double")
    area = F.try_divide(twice, 2.0 * F.sum("n").cast("double") * F.sum("p").cast("double"))
    return curve.agg(area.alias("auc"), F.max_by("threshold", F.struct(F.col("tpr") - F.col("fpr"), F.col("threshold"))).alias("best_threshold"))


def residuals(long: DataFrame, back: DataFrame, keys: tuple[str, ...] = ("cycle_id", "t")) -> DataFrame:
    """(keys, e2): squared difference of samples and their approximation; samples that it lacks are left out."""
    return long.join(back.withColumnRenamed("x", "_y"), list(keys)).select(*keys, F.pow(F.col("x") - F.col("_y"), 2).alias("e2"))


def error_report(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``residuals``: (t, sse), (cycle_id, sse), and one row with the distribution over cycles and the worst of them."""
    by_cycle = e.groupBy("cycle_id").agg(F.sum("e2").alias("sse"))
    summary = by_cycle.agg(F.avg("sse").alias("mean"), F.skewness("sse").alias("skew"), (F.kurtosis("sse") + 3).alias("kurt"), F.max_by("cycle_id", F.struct("sse", -F.col("cycle_id"))).alias("worst"))
    return e.groupBy("t").agg(F.sum("e2").alias("sse")), by_cycle, summary
