"""Near copies by the exact Jaccard similarity of their word shingles: a prefix-filtered similarity join.

All shingles have one global order, roughly from rare to common. Two sets of similarity p / q or more share one of
the first n - ceil(n p / q) + 1 shingles of each, so joining these prefixes finds every such pair, at whatever
distance their SimHash fingerprints are; each candidate is then verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import bounded_batches, by_ids, lean, written
from skein.llm.components import components
from skein.llm.simhash import shingle_hashes

WORDS = 5
#: The least similarity, as a fraction so that the bound itself is exact.
SIMILARITY = (4, 5)
#: Shingles are counted by so many leading bits of their hash; the counts only order them.
ORDER_BITS = 17
#: Buckets of more sets than this link through stars first. A set takes the stars of so many of its large buckets.
BUCKET, STARS = 32, 4
_MOST_FILTER_BITS = 28


def shingle_set(text: bytes | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """A name of the set of shingles (equal sets share it) and its sorted hashes. Blank texts have the empty set."""
    from hashlib import blake2b

    found = np.unique(shingle_hashes(text or b"", words).astype(np.uint64))
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True), found


def _order(slim: DataFrame, words: int) -> np.ndarray:
    """How many shingles of the corpus fall on each leading ``ORDER_BITS`` bits: an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                held += 0 if x.as_py() is None else np.bincount((shingle_set(x.as_py(), words)[1] >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(held))
        here = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(held[here])], ["slot", "n"])

    counts = np.zeros(1 << ORDER_BITS, np.int64)
    got = slim.select("_text").mapInArrow(lean(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return counts


def _prefixes(slim: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(token, node, n, pos): the shingles of each set's prefix, the set's name and size, and the shingle's place in the global order."""
    p, q = similarity
    shared = slim.sparkSession.sparkContext.broadcast(_order(slim, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for x in batch.column(0):
                node, found = shingle_set(x.as_py(), words)
                n = len(found)
                if not n:
                    continue
                size = n + (-p * n // q) + 1
                first = np.argsort(counts[(found >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], kind="stable")[:size]
                for held, x in zip(cols, (found[first].view(np.int64), np.full(size, node), np.full(size, n, np.int32), np.arange(size, dtype=np.int32)), strict=True):
                    held.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["token", "node", "n", "pos"])

    return slim.select("_text").mapInArrow(lean(run), "token long, node long, n int, pos int")


def _filter(nodes: DataFrame, n: int) -> np.ndarray:
    """A bit for each name's low bits; of bounded size."""
    bits = min(max((8 * n).bit_length(), 10), _MOST_FILTER_BITS)
    slot = F.col("node").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    got = nodes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("held")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[got.column("word").to_numpy()] = got.column("held").to_numpy()
    return out


def _sets(slim: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, all, parity): the whole sets of ``nodes``, once each, and of 256 classes of shingles whether the set has an odd number."""
    shared = slim.sparkSession.sparkContext.broadcast(_filter(nodes, nodes.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            names, found, parity = [], [], []
            for x in batch.column(0):
                node, own = shingle_set(x.as_py(), words)
                slot = node & (64 * len(held) - 1)
                if int(held[slot >> 6]) >> (slot & 63) & 1:
                    names.append(node)
                    found.append(own.view(np.int64))
                    parity.append(np.packbits(np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, lists), pa.array(parity, lists)], ["node", "all", "parity"])

    return slim.select("_text").mapInArrow(lean(run), "node long, all array<long>, parity array<long>").dropDuplicates(["node"])


def near_roots(slim: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(node, root): the components of all distinct sets of ``slim`` (_text) over links of ``similarity`` or more, direct ones or paths of them; sets without any are left out.

    The sets of a bucket share a shingle of their prefixes. In buckets of up to ``bucket`` every pair is a candidate. In
    a larger one all sets are candidates with one of them, picked by the bucket's shingle; then only pairs that these
    links leave in different components are: each set outside the bucket's largest component with each other set.
    The links of these are few, and join components that are then one node each.
    """
    p, q = similarity

    def may(a: str, b: str) -> Column:
        """Sizes, and places of the first shared shingle, that allow the similarity."""
        n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
        return (q * F.least(n, m) >= p * F.greatest(n, m)) & ((p + q) * F.least(n - i, m - j) >= p * (n + m))

    pair = lambda: [F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")]
    rows = _prefixes(slim, words, similarity).repartition("token").dropDuplicates(["token", "node"])
    held = written(rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("size > 1"), "shingle-buckets")
    small, large = held.where(F.col("size") <= bucket), held.where(F.col("size") > bucket)
    first = small.alias("a").join(small.alias("b"), "token").where((F.col("a.node") < F.col("b.node")) & may("a", "b")).select(*pair()).distinct()
    any_large = not large.isEmpty()
    if any_large:
        centre = large.groupBy("token").agg(F.min_by("node", F.xxhash64("token", "node")).alias("u"))
        own = large.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("token").alias("h"), "token"))), 1, STARS).alias("few"))
        stars = own.select("node", F.explode("few.token").alias("token")).join(centre, "token").where("node <> u")
        first = first.union(stars.select(F.least("node", "u").alias("u"), F.greatest("node", "u").alias("v"))).distinct()
    first = written(first, "near-candidates")
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).union(large.select("node")).distinct()
    sets = written(_sets(slim, nodes, words), "shingle-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("all").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("all").alias("y")), "v")
        shared = F.size(F.array_intersect("x", "y")).cast("long")
        return written(both.where((p + q) * shared >= p * (F.size("x") + F.size("y")).cast("long")).select("u", "v"), "near-links")

    roots = components(verified(first))
    if not any_large:
        return roots
    roots = written(roots, "near-roots")
    marked = large.join(roots, "node", "left").join(sets.select("node", "parity"), "node")
    members = written(marked.select("token", "node", "n", "pos", "parity", F.coalesce("root", "node").alias("root")), "near-members")
    most = members.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "most")
    apart = members.join(most, "token")
    # Sets differ in at least as many shingles as classes of odd numbers: most pairs that aren't near end here.
    differ = reduce(Column.__add__, [F.bit_count(F.col("a.parity")[k].bitwiseXOR(F.col("b.parity")[k])) for k in range(4)])
    like = (p + q) * differ <= (q - p) * (F.col("a.n") + F.col("b.n"))
    more = apart.where("root <> most").alias("a").join(apart.alias("b"), "token").where((F.col("a.root") != F.col("b.root")) & may("a", "b") & like).select(*pair()).distinct()
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_"))
    found = verified(more.join(first, ["u", "v"], "left_anti")).join(of("u"), "u", "left").join(of("v"), "v", "left")
    last = components(found.select(F.coalesce("u_", "u").alias("u"), F.coalesce("v_", "v").alias("v")))
    moved = roots.join(last.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return moved.union(last.join(roots, "node", "left_anti"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """One row per document: id, component_id (smallest id reachable over pairs of ``similarity`` or more).

    Words are as in op2_simhash; texts of fewer than ``words`` words are one shingle. Null and blank texts are one
    group. A null id is never a component's name unless all its ids are null. Repeated rows are repeated in the
    result; empty input gives an empty result.
    """
    slim = bounded_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(x.as_py(), words)[0] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], ["_id", "node"])

    names = written(slim.mapInArrow(lean(run), f"_id {slim.schema['_id'].dataType.simpleString()}, node long"), "shingle-names")
    roots = near_roots(slim, words, similarity, bucket)
    least = names.groupBy("node").agg(F.min("_id").alias("least"))
    named = least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return names.join(named.join(best, "root").select("node", "component_id"), "node").select(F.col("_id").alias(id_col), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group, all columns."""
    kept = near_groups(docs, id_col, text_col, words, similarity).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col)
    return by_ids(docs, kept, id_col)
