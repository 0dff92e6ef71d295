"""A multilayer perceptron on packed features, by Spark ML."""

from __future__ import annotations

import math

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layers(inputs: int, classes: int, depth: int) -> list[int]:
    """``depth`` hidden layers of ceil(inputs / (2 i)) units."""
    return [inputs, *[max(1, math.ceil(inputs / (2 * k))) for k in range(1, depth + 1)], classes]


def fit(packed: DataFrame, depth: int = 2, rounds: int = 30, seed: int = 1) -> tuple[MultilayerPerceptronClassificationModel, list]:
    """The model and its classes in order. Sigmoid hidden layers; the budget is rounds of L-BFGS, not time."""
    classes = sorted(r[0] for r in packed.select("target").distinct().collect())
    rows = packed.select(array_to_vector("features").alias("features"), (F.array_position(F.lit(classes), F.col("target")) - 1).cast("double").alias("label"))
    inputs = packed.select(F.size("features").alias("n")).first().n
    return MultilayerPerceptronClassifier(layers=layers(inputs, len(classes), depth), maxIter=rounds, seed=seed).fit(rows), classes


def predict(model: MultilayerPerceptronClassificationModel, classes: list, packed: DataFrame) -> DataFrame:
    """(cycle_id, prediction)."""
    rows = packed.select("cycle_id", array_to_vector("features").alias("features"))
    return model.transform(rows).select("cycle_id", F.get(F.lit(classes), F.col("prediction").cast("int")).alias("prediction"))
