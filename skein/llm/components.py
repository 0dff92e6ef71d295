"""Connected components of an edge table: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v), any order, to (node, root): the smallest node of each node's component.

    Each round only groups by node and joins the minima back, so a hub with very many neighbours is aggregated
    on the map side and its join is split like any skewed join. Each round is written to the shared folder.
    No edges give an empty result.
    """
    pairs = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    before, n = None, pairs.count()
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("u"), "v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v").union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
        pairs = written(small.distinct(), "edges", n)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).union(pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
