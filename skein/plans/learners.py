"""Queries on learners fitted by summed gradients, and on the number of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.layout import rounded
from skein.operators import gradient, novelty, regress, subspace
from skein.sources.tables import embedding_features


def _regression(spark, d):
    rows = embedding_features(spark, d).where("target is not null")
    return rows.select("cycle_id", "features", (F.get("features", F.lit(0)) * 3 - F.get("features", F.lit(1)) + F.abs(F.get("features", F.lit(2)))).alias("y"))


def _kernel(rows, size=64):
    rff = regress.FourierFeatures.of(subspace.moments(rows)[()], size)
    return rows.withColumn("features", rff(F.col("features"))).persist()


def q75_support_vectors(spark, d):
    """Pairwise hinge machines on Fourier features of an RBF kernel."""
    rows = _kernel(embedding_features(spark, d))
    return rows.select("cycle_id", "target", gradient.support_vectors(rows, rounds=15).predict(F.col("features")).alias("prediction"))


def q76_support_regression(spark, d):
    """Epsilon-insensitive regression on Fourier features."""
    rows = _kernel(_regression(spark, d))
    return rows.select("cycle_id", "y", gradient.support_regression(rows, insensitive=0.02, rounds=15).predict(F.col("features")).alias("prediction"))


def q77_trained_network(spark, d):
    """A network of one trained hidden layer, and the reconstruction error of a trained auto-encoder with its threshold."""
    rows = _regression(spark, d).persist()
    m = subspace.moments(rows, also=("y",))[()]
    net = gradient.network(rows, m, rounds=30)
    auto = gradient.network(rows, m.of(list(range(len(m.mean) - 1))), (2,), target=None, rounds=30)
    scored = rows.select("cycle_id", "y", net.predict(F.col("features")).alias("prediction"), auto.score(F.col("features")).alias("score"))
    return novelty.decided(scored, gradient.auto_encoder_threshold(rows, auto), auto.higher_is_novel)


def q78_one_class_machine(spark, d):
    rows = _kernel(embedding_features(spark, d))
    model = gradient.one_class_machine(rows, rounds=15)
    return novelty.decided(rows.select("cycle_id", model.score(F.col("features")).alias("score")), 0.0, model.higher_is_novel)


def q79_gap_statistic(spark, d):
    """Gaps of 1 to 50 clusters of all embeddings, and the number chosen."""
    found = novelty.gap_statistic(embedding_features(spark, d))
    rows = [(k + 1, float(g), float(e), k + 1 == found.k) for k, (g, e) in enumerate(zip(found.gaps, found.errors, strict=True))]
    return spark.createDataFrame(rows, "k int, gap double, error double, chosen boolean").select("k", rounded(F.col("gap")).alias("gap"), rounded(F.col("error")).alias("error"), "chosen")


def q80_mixture_of_chosen_size(spark, d):
    """Density of a mixture whose size the gap statistic chose, below its threshold novel."""
    rows = embedding_features(spark, d).withColumn("features", F.slice("features", 1, 4)).persist()
    scored = rows.select("cycle_id", novelty.mixture(rows).score(F.col("features")).alias("score"))
    return novelty.decided(scored, novelty.low_threshold(scored), False)


NAMED = [v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()]


def oracle() -> dict[str, str]:
    return {}
