"""Packed and long layouts of cycles and features, and the shape of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a column that a vectorised function takes at a time, and that an Arrow batch of long arrays should hold.
PIECE = 1 << 20


def short_batches(df: DataFrame, length: int) -> DataFrame:
    """``df`` of arrays of ``length``, after lowering the session's bound of rows in an Arrow batch: thousands of numbers in the usual 10,000 rows would fill a worker."""
    conf = df.sparkSession.conf
    rows, held = max(PIECE // max(length, 1), 1), int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < held <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def pack(long: DataFrame, keys: tuple[str, ...] = ("cycle_id", "sensor"), at: str = "t", values: dict[str, str] | None = None) -> DataFrame:
    """Long rows to one array per cycle and sensor, in the order of ``at``. ``values`` names the arrays: {"samples": "x", "u": "u"}."""
    values = values or {"samples": "x", "u": "u"}
    held = F.sort_array(F.collect_list(F.struct(at, *values.values())))
    packed = long.groupBy(*keys).agg(held.alias("_held"))
    return packed.select(*keys, *[F.col("_held")[column].alias(name) for name, column in values.items()])


def unpack(packed: DataFrame, keys: tuple[str, ...] = ("cycle_id", "sensor"), arrays: dict[str, str] | None = None, at: str = "t") -> DataFrame:
    """One row per element, ``at`` counting from 1."""
    arrays = arrays or {"samples": "x", "u": "u"}
    first = next(iter(arrays))
    rest = [F.get(F.col(a), F.col("_k")).alias(name) for a, name in arrays.items() if a != first]
    rows = packed.select(*keys, *arrays, F.posexplode(first).alias("_k", arrays[first]))
    return rows.select(*keys, (F.col("_k") + 1).alias(at), arrays[first], *rest)


def with_shared_uncertainty(long: DataFrame, per_sample: DataFrame) -> DataFrame:
    """``u`` from one row per sensor and sample (sensor, t, u) for all cycles: a table of the length of a cycle, so it is broadcast."""
    return long.drop("u").join(F.broadcast(per_sample), ["sensor", "t"])


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero; null for what is not a finite number."""
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)
    return F.round(x, digits) + F.lit(0.0)


def compact(x: Column) -> Column:
    """Signed logarithm of 1 + |x|, rounded: for statistics whose decimals end in exact ties."""
    return rounded(F.signum(x) * F.log1p(F.abs(x)), 7)


def stacked(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide statistics to (keys, feature_idx, value), features counted from 1 in the order of ``columns``."""
    items = [F.struct(F.lit(k + 1).alias("feature_idx"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)]
    return df.select(*keys, F.explode(F.array(*items)).alias("_f")).select(*keys, "_f.feature_idx", "_f.value")


def _by_length(*columns: pd.Series) -> list[list[int]]:
    """Places of the rows that have all arrays, of one length, together by that length, as many as hold PIECE numbers."""
    sizes: dict[int, list[int]] = {}
    for k, arrays in enumerate(zip(*columns, strict=True)):
        if all(x is not None for x in arrays) and len({len(x) for x in arrays}) == 1:
            sizes.setdefault(len(arrays[0]), []).append(k)
    return [at[k : k + step] for n, at in sizes.items() for step in [max(PIECE // max(n, 1), 1)] for k in range(0, len(at), step)]


def _matrix(column: pd.Series, at: list[int]) -> np.ndarray:
    values = column.to_numpy()
    return np.concatenate([values[k] for k in at]).astype(float).reshape(len(at), -1) if len(values[at[0]]) else np.zeros((len(at), 0))


def matrices(values: pd.Series) -> Iterator[np.ndarray]:
    """A column's arrays, rows of one length as a matrix. Null is left out."""
    return (_matrix(values, at) for at in _by_length(values))


def matrix_udf(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[..., Column]:
    """A vectorised array function: rows of one length meet as a matrix, ``fn`` returns one row for each. Null gives null."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        out = [None] * len(values)
        for at in _by_length(values):
            for k, row in zip(at, fn(_matrix(values, at)), strict=True):
                out[k] = row
        return pd.Series(out)

    return run


def pair_udf(fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[..., Column]:
    """``matrix_udf`` of two arrays of one length; null where either is null, or where their lengths differ."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None] * len(a)
        for at in _by_length(a, b):
            for k, row in zip(at, fn(_matrix(a, at), _matrix(b, at)), strict=True):
                out[k] = row
        return pd.Series(out)

    return run
