import random

from pyspark.sql import functions as F

from skein.streaming import cycles


def rows_of(df):
    return sorted((r.user_id, r.n, round(r.mean, 6), None if r.variance is None else round(r.variance, 4), r.least, r.greatest) for r in df.collect())


def test_running_totals_equal_the_batch_over_files_late_rows_and_a_restart(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randrange(6), f"2024-01-{1 + k % 28:02d}", 1e8 + rnd.random()) for k in range(400)] + [(99, "2023-01-01", None)]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "user_id long, day string, value double")
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    v = F.col("value")
    want = lambda part: rows_of(part.groupBy("user_id").agg(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.var_samp(v).alias("variance"), F.min(v).alias("least"), F.max(v).alias("greatest")))
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], table.schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: cycles.update_totals(cycles.stream_of(spark, source, 1), path, ("user_id",), "value").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    assert rows_of(run()) == want(spark.createDataFrame(rows[:300], table.schema))
    spark.createDataFrame(rows[300:], table.schema).coalesce(1).write.mode("append").parquet(source)
    assert rows_of(run()) == want(table)
    assert rows_of(run()) == want(table)
