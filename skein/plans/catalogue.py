"""The query catalogue: one entry per operator group, and the SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import cycles, features, learners, resampled, spectra, stacks, streams

MODULES = (cycles, spectra, features, streams, stacks, learners, resampled)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.NAMED}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle().items()}
