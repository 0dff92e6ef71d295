"""Running sums along an order without a task that holds a whole group, and small tables set beside large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.storage import stored

#: A key with a share of at least 1 / HOT of all rows is hot; so there are at most so many, and they are broadcast.
HOT = 1 << 16


def running(rows: DataFrame, order: tuple[str, ...], sums: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``<name>_before`` for each of ``sums``: the sum over those rows of the group that come before, in ascending ``order`` (nulls first).

    ``rows`` has one row for each group and place in the order; null groups are a group. The rows are cut by ranges, sums run
    within a range, and the sums of a group's earlier ranges, of which there are no more than partitions, are added. The cut
    rows are written once, as a second evaluation might draw other ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    earlier = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums])
    ranges = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = whole.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_range"), *[F.coalesce(F.sum(f"_sum_{c}").over(ranges), F.lit(0)).alias(f"_sum_{c}") for c in sums])
    met = F.col("_part") == F.col("_range")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return inside.join(whole, met).select(*rows.columns, *[(F.col(f"{c}_before") + F.col(f"_sum_{c}")).alias(f"{c}_before") for c in sums])


def beside(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], count: str, **of: Column) -> DataFrame:
    """``rows`` with the columns ``of`` of ``table``, which has each combination of ``keys`` (nulls included) once and, as ``count``, at least how many rows have it.

    Rows of hot keys take theirs from a broadcast of at most HOT rows and are then spread over all tasks of the other join.
    """
    total, least = table.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.min(count), F.lit(0))).first()
    named = table.select(F.col(count).alias("_count"), F.struct(*[c.alias(n) for n, c in of.items()]).alias("_of"), *[F.col(k).alias(f"_key_{k}") for k in keys])
    met = lambda side: [F.col(k).eqNullSafe(F.col(f"{side}_{k}")) for k in keys]
    is_hot = F.col("_count") * HOT >= total
    hot = named.where(is_hot).select(F.col("_of").alias("_hot_of"), *[F.col(f"_key_{k}").alias(f"_hot_{k}") for k in keys])
    tried = rows.join(F.broadcast(hot), met("_hot"), "left").drop(*[f"_hot_{k}" for k in keys])
    if least * HOT >= total:
        return tried.select(*rows.columns, *[F.col(f"_hot_of.{n}").alias(n) for n in of])
    spread = F.when(F.col("_hot_of").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(HOT)) + 1)
    cold = named.where(~is_hot).withColumn("_none", F.lit(0).cast("long"))
    joined = tried.withColumn("_spread", spread.cast("long")).join(cold, [*met("_key"), F.col("_spread") == F.col("_none")], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_hot_of.{n}"), F.col(f"_of.{n}")).alias(n) for n in of])
