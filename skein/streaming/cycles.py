"""Streams: mergeable sums batch by batch, and cycles assembled in watermarked windows and scored by a fitted model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions.storage import shared_dir


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of a Parquet file or folder, with the schema that is there. As a pattern the path may be either."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame:
    """All that is there now, run to its end: each batch goes through ``each`` or to a table in the shared folder, which is returned."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        # The folder of a batch is its number: a batch that is run again after a failure replaces itself.
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if each is None and mode == "append":
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("batch")


def incremental_sums(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, n, s, q): count, sum and sum of squares. Every batch leaves partial sums; partial sums add up, so streams, batches and other trainings merge alike."""
    partial = lambda batch, _: batch.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    return merged(drained(stream_of(spark, path), partial), key)


def merged(sums: DataFrame, key: str) -> DataFrame:
    return sums.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def update_totals(stream: DataFrame, path: str, by: tuple[str, ...], value: str) -> DataFrame:
    """(by, n, mean, variance, least, greatest) of all rows so far: runs what is new in ``stream`` to its end and returns the totals.

    Keyed state in ``path``/state carries each group's centred sums from batch to batch and over restarts; its size is that of the
    groups. There is no watermark: late rows count like others. A batch leaves the new totals of the groups it touched, in a folder
    of its number, so a batch that is run again after a failure replaces itself, and a group's last batch has its total. Calling this again with
    more files, the same ``path`` and the same query goes on from there.
    """
    spark = stream.sparkSession
    v = F.col(value)
    totals = stream.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.min(v).alias("least"), F.max(v).alias("greatest"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")

    query = totals.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_totals(spark, path, by, totals.schema)


def read_totals(spark: SparkSession, path: str, by: tuple[str, ...], schema: StructType) -> DataFrame:
    """Each group's row of the last batch that touched it."""
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).option("basePath", f"{path}/totals").parquet(f"{path}/totals")
    names = [c for c in rows.columns if c not in (*by, "batch")]
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*names), "batch").alias("_t"))
    return last.select(*by, "_t.*")


def windowed_cycles(stream: DataFrame, time: str, value: str, width: str = "1 day", late: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, by, n, mean, max) of each closed tumbling window. Rows later than ``late`` behind the newest are dropped."""
    rows = stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", width), *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(F.col("window.start").alias("window_start"), *by, "n", "mean", "max")


def scored(cycles: DataFrame, center: float, threshold: float) -> DataFrame:
    """A narrow map with the model's numbers: distance of the cycle's mean from the training mean, novel above the threshold."""
    distance = F.abs(F.col("mean") - center)
    return cycles.withColumn("score", distance).withColumn("is_novel", distance > threshold)
