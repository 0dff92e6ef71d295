"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import ascii_lower, by_ids, written


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id
    stays. Stage 1 deduplicates inside each map task (the map side of the first grouping), stage 2 merges each
    digest group in ``salts`` salted parts, stage 3 combines the parts' winners. Every stage groups by the full
    text beside its digest, so equal digests of different texts never merge. A text that fills a third of all
    rows leaves each map task as at most ``salts`` rows. Empty input gives an empty result; repeated ids count
    as rows of their own; a null id never wins over another id; other columns of ``docs`` are ignored.
    """
    text = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("_digest"), text.alias("_text"))
    parts = rows.groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_text").agg(
        F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")
    )
    texts = parts.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    # Winners leave their text behind: only digests that several texts share need it again.
    winners = written(
        texts.groupBy("_digest").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts")),
        "exact-winners",
    )
    alone = winners.where("_texts = 1").select("_digest", "_keep", "_n")
    found = rows.select("_id", "_digest").join(alone, "_digest")
    if not winners.where("_texts > 1").isEmpty():
        shared = winners.where("_texts > 1").select("_digest")
        of_text = texts.join(shared, "_digest", "left_semi")
        found = found.unionByName(
            rows.join(shared, "_digest", "left_semi").join(of_text, ["_digest", "_text"]).select("_id", "_digest", "_keep", "_n")
        )
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat an id stay together."""
    kept = exact_groups(docs, id_col, text_col, salts).where("kept").select(id_col)
    return by_ids(docs, kept, id_col)
