"""Cycles and feature matrices from Parquet tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.layout import short_batches
from skein.functions.storage import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standard_uncertainty(x: Column, share: float = 0.01, floor: float = 0.001) -> Column:
    return F.abs(x) * share + floor


#: A cycle's id is its user's plus its number among the user's cycles (from 0) times this.
CYCLES = 1 << 32


#: Users of more events are numbered hour by hour, the others each in one window.
MANY = 1 << 18


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events: user_id, value, gap (seconds since the user's event before, 0 at first), r (place among the user's events by time, from 1), n and total (the user's events and their sum).

    The counts and sums of users are stored first. The driver gets the ids of those with over MANY events, of which there is one in MANY events at most.
    """
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", at).where(F.col("user_id").isNotNull())
    users = stored(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "users")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("at") - F.lag("at").over(own), F.lit(0.0))
    many = [r.user_id for r in users.where(F.col("n") > MANY).collect()]
    few = rows.where(~F.col("user_id").isin(many)) if many else rows
    numbered = few.join(users, "user_id").select("user_id", "value", gap.alias("gap"), F.row_number().over(own).cast("long").alias("r"), "n", "total")
    return numbered.union(_numbered_by_hour(rows.where(F.col("user_id").isin(many)))) if many else numbered


def _numbered_by_hour(rows: DataFrame) -> DataFrame:
    """Places are those within an hour plus the counts of the user's earlier hours, so no task sorts a whole user."""
    hour = F.coalesce(F.date_trunc("hour", F.col("ts").cast("timestamp")), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    rows = rows.withColumn("hour", hour)
    hours = rows.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("k"), F.max("at").alias("last"), F.sum("value").alias("s"))
    by, user = Window.partitionBy("user_id").orderBy("hour"), Window.partitionBy("user_id")
    before = F.coalesce(F.sum("k").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select("user_id", "hour", before.alias("before"), F.lag("last").over(by).alias("last"), F.sum("k").over(user).alias("n"), F.sum("s").over(user).alias("total"))
    own = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("at") - F.coalesce(F.lag("at").over(own), F.col("last")), F.lit(0.0))
    return rows.join(hours, ["user_id", "hour"]).select("user_id", "value", gap.alias("gap"), (F.row_number().over(own) + F.col("before")).alias("r"), "n", "total")


def _placed(events: DataFrame, length: int) -> DataFrame:
    """Each event in its cycles: cycle_id, t and the event's columns.

    A user's cycles are the consecutive runs of ``length`` events; where some are left at the end, the last
    ``length`` events are one more cycle, so every event is in a cycle. Fewer events than that are none.
    """
    r, n = F.col("r"), F.col("n")
    number, last = F.floor((r - 1) / length), F.floor(n / length)
    full = F.when((number + 1) * length <= n, F.struct(number.alias("c"), (r - number * length).cast("int").alias("t")))
    rest = F.when((n % length != 0) & (n >= length) & (r > n - length), F.struct(last.alias("c"), (r - (n - length)).cast("int").alias("t")))
    each = events.withColumn("place", F.explode(F.array(full, rest))).where(F.col("place").isNotNull())
    return each.withColumn("cycle_id", F.col("user_id") + F.col("place.c") * CYCLES).withColumn("t", F.col("place.t")).drop("place")


def event_cycles(spark: SparkSession, sf_dir: str, length: int = 40, sensors: tuple[str, ...] = ("value",)) -> DataFrame:
    """Long cycles (cycle_id, sensor, t, x, u) of all events. Sensor ``gap`` is seconds since the user's event before, 0 at first."""
    lanes = [F.struct(F.lit(s).alias("sensor"), F.col(s).alias("x")) for s in sensors]
    long = _placed(numbered_events(spark, sf_dir), length).select("cycle_id", "t", F.explode(F.array(*lanes)).alias("s")).select("cycle_id", "s.sensor", "t", "s.x")
    return long.withColumn("u", standard_uncertainty(F.col("x")))


def _targets(length: int, alone: Column | None = None) -> list[Column]:
    other = (F.first("total") - F.sum("value")) / F.nullif(F.first("n") - length, F.lit(0))
    return [(F.first("user_id") % 3).alias("target"), F.coalesce(other, F.first("total") / F.first("n") if alone is None else alone).alias("y")]


def event_targets(spark: SparkSession, sf_dir: str, length: int = 40, alone: Column | None = None) -> DataFrame:
    """(cycle_id, target, y): class user_id mod 3, and the mean value of the user's other events (where there are none ``alone``, by default the mean of all)."""
    return _placed(numbered_events(spark, sf_dir), length).groupBy("user_id", "cycle_id").agg(*_targets(length, alone)).drop("user_id")


def labelled_cycles(spark: SparkSession, sf_dir: str, length: int = 40, sensors: tuple[str, ...] = ("value",)) -> DataFrame:
    """Packed ``event_cycles`` beside their ``event_targets`` (cycle_id, sensor, samples, u, target, y): events are numbered once and meet once by cycle."""
    held = F.sort_array(F.collect_list(F.struct("t", *sensors)))
    cycles = _placed(numbered_events(spark, sf_dir), length).groupBy("user_id", "cycle_id").agg(held.alias("h"), *_targets(length))
    lanes = [F.struct(F.lit(s).alias("sensor"), F.col("h")[s].alias("samples")) for s in sensors]
    packed = cycles.select("cycle_id", F.explode(F.array(*lanes)).alias("s"), "target", "y")
    return packed.select("cycle_id", "s.sensor", "s.samples", F.transform("s.samples", lambda x: standard_uncertainty(x)).alias("u"), "target", "y")


def daily_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed (cycle_id, samples, u): a supplier's shipped quantity on each day from the table's first to its last, 0 on days without.

    Lines without a supplier or date are left out, a missing quantity counts as 0. Lines are added up by supplier and day before a
    supplier's days meet, so a task holds days, never lines.
    """
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cycle_id"), F.datediff("l_shipdate", F.lit("1970-01-01")).alias("day"), "l_quantity").dropna(subset=["cycle_id", "day"])
    span = rows.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    first, length = (span["first"], span["last"] - span["first"] + 1) if span["first"] is not None else (0, 0)

    @F.pandas_udf("array<double>")
    def dense(day: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for d, v in zip(day, x, strict=True):
            own = np.zeros(length)
            own[np.asarray(d) - first] = v
            out.append(own)
        return pd.Series(out, dtype=object)

    daily = rows.groupBy("cycle_id", "day").agg(F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("x"))
    held = daily.groupBy("cycle_id").agg(F.collect_list(F.struct("day", "x")).alias("h"))
    packed = short_batches(held, length).select("cycle_id", dense(F.col("h.day"), F.col("h.x")).alias("samples"))
    return packed.withColumn("u", F.transform("samples", lambda x: standard_uncertainty(x)))


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed (cycle_id, target, features): 64 doubles a row."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cycle_id"), F.col("label").alias("target"), F.col("embedding").cast("array<double>").alias("features"))


def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_returnflag").alias("target"))
