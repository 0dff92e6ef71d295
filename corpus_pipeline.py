"""The corpus pipeline: toxicity, exact and near deduplication, decontamination, tokens. Each stage keeps whole rows of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, exact_dedup, jaccard, simhash, toxicity
from skein.llm.common import by_ids, written
from skein.llm.components import components
from skein.llm.queries import table, tokenizer, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learnt from the labels that are not held out."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash fingerprints at most two bits apart, as op2 links them, or by a Jaccard similarity of
    0.8 or more of five-word shingles, the smallest doc_id. The second finds the near copies that differ in more bits."""
    prints = written(simhash.near_groups(docs).select("doc_id", "component_id"), "fingerprint-groups")
    exact = written(jaccard.near_groups(docs), "shingle-groups")
    roots = components(prints.union(exact).toDF("u", "v"))
    kept = exact.join(roots, F.col("doc_id") == F.col("node"), "left").where(F.coalesce("root", "component_id").eqNullSafe(F.col("doc_id")))
    return by_ids(docs, kept.select("doc_id"), "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens of every document, and decoded_sha256 of the bytes that its ids give back."""
    path, pattern = tokenizer()
    both = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, decoded_col="decoded")
    return both.withColumn("n_tokens", F.size("token_ids").cast("long")).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte-level bpe", tokens),
]

#: The toxicity grammar's fitted weights can't be stated in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
