"""Queries on streams: each must equal its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions.layout import compact, rounded
from skein.functions.storage import shared_dir
from skein.plans.cycles import R
from skein.streaming import cycles

CENTER, LIMIT = 50.0, 5.0


def q58_incremental_sums(spark, d):
    sums = cycles.incremental_sums(spark, f"{d}/events.parquet", "user_id", "value")
    return sums.select("user_id", "n", compact(F.col("s")).alias("log_s"), compact(F.col("q")).alias("log_q"))


def q59_windowed_cycles(spark, d):
    stream = cycles.windowed_cycles(cycles.stream_of(spark, f"{d}/events.parquet"), "ts", "value", by=("event_type",))
    rows = cycles.scored(cycles.drained(stream), CENTER, LIMIT)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("max")).alias("max"), rounded(F.col("score")).alias("score"), "is_novel")


def q81_running_totals(spark, d):
    """Totals of each user from keyed stream state."""
    path = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    rows = cycles.update_totals(cycles.stream_of(spark, f"{d}/events.parquet"), path, ("user_id",), "value")
    return rows.select("user_id", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "variance", "least", "greatest")])


NAMED = [q58_incremental_sums, q59_windowed_cycles, q81_running_totals]


def oracle() -> dict[str, str]:
    return {
        "q81_running_totals": f"select user_id, count(value) n, {R('avg(value)')} mean, {R('var_samp(value)')} variance, {R('min(value)')} least, {R('max(value)')} greatest from events group by 1",
        "q58_incremental_sums": f"select user_id, count(value) n, {R('sign(sum(value)) * ln(1 + abs(sum(value)))', 7)} log_s, {R('ln(1 + sum(value * value))', 7)} log_q from events group by 1",
        "q59_windowed_cycles": f"""select strftime(date_trunc('day', ts), '%Y-%m-%d') "day", event_type, count(value) n, {R('avg(value)')} mean, {R('max(value)')} "max", {R(f'abs(avg(value) - {CENTER}::DOUBLE)')} score, abs(avg(value) - {CENTER}) > {LIMIT} is_novel
from events, (select max(ts) - interval 1 day w from events) where date_trunc('day', ts) + interval 1 day <= w group by 1, 2, date_trunc('day', ts)""",
    }
