"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits, each a word of 23 bits with leading zeros. The
binary Golay code has a codeword within 3 bits of every 23-bit word, and words that differ in one bit share a
codeword within 4 bits of both. Two errors over three segments leave, for one segment z, no error in z and at
most one in the next segment x: so each fingerprint gets, for each z, the keys (z exact, index of a codeword near
x). Of two words that differ in one bit one has an even number of ones; it carries all its codewords within 4
bits (one or six) and the odd word just its nearest, which still meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, by_ids, lean, written
from skein.llm.components import components

MAX_BITS = 2
#: Fixed value: the generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: (shift, width) of the segments; segment k + 1 is the fuzzy one beside the exact segment k.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words of the A-Z lower-cased text; fewer words make one run."""
    from itertools import repeat

    from xxhash import xxh64_digest

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        runs = [b" ".join(found)]
    else:
        runs = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    return np.frombuffer(b"".join(map(xxh64_digest, runs, repeat(42))), ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is 1 in over half of the hashes; 0 for no hashes. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long) of every row. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [fingerprint(shingle_hashes(x.as_py() or b"", words)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], ["_id", "fp"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return bounded_batches(slim).mapInArrow(lean(run), f"_id {slim.schema['_id'].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_col)


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all 12-bit high parts, and for each syndrome the error patterns of weight <= 3 (one) and 4 (none or five), -1 where absent."""
    from itertools import combinations

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    high = np.array([remainder(x << 11) for x in range(1 << 12)], np.int64)
    unit = [remainder(1 << k) for k in range(23)]
    patterns = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, int)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = error = 0
            for k in bits:
                s ^= unit[k]
                error |= 1 << k
            if weight < 4:
                patterns[s, 0] = error
            else:
                used[s] += 1
                patterns[s, used[s]] = error
    return high, patterns


def near_codewords(x: np.ndarray) -> np.ndarray:
    """For 23-bit words: the 12-bit indices of the nearest codeword (first column) and of those 4 bits away, -1 where there is none."""
    high, patterns = _golay()
    errors = patterns[high[x >> 11] ^ (x & 0x7FF)]
    return np.where(errors < 0, -1, (x[:, None] ^ errors) >> 11)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: fingerprints at most two bits apart share a key."""
    fp = fp.view(np.uint64)
    parts = [(fp >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for k, exact in enumerate(parts):
        fuzzy = parts[(k + 1) % 3]
        near = near_codewords(fuzzy)
        near[np.bitwise_count(fuzzy) % 2 == 1, 1:] = -1
        r, c = np.nonzero(near >= 0)
        rows.append(r)
        keys.append(((k << 22 | exact[r]) << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def near_edges(prints: DataFrame, bucket: int = 64) -> DataFrame:
    """Links (u, v) that connect all distinct ``fp`` at most two bits apart, as direct or two-step paths.

    Buckets of up to ``bucket`` fingerprints are joined with themselves and verified. The fingerprints of larger
    buckets take an exact way that never pairs them: each names itself and its 64 one-bit neighbours as meeting
    points; fingerprints at most two bits apart share one, and all (at most 65) that share one are that near, so
    each is linked to the smallest of its point.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            rows, keys = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(keys)], ["fp", "key"])

    n = 10 * prints.count()
    keyed = written(prints.select("fp").mapInArrow(lean(run), "fp long, key long"), "golay-keys", n)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = written(keyed.join(sizes, "key"), "golay-buckets", n)
    small = held.where(F.col("n") <= bucket)
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    pairs = (
        small.select("key", F.col("fp").alias("u"))
        .join(small.select("key", F.col("fp").alias("v")), "key")
        .where((F.col("u") < F.col("v")) & (apart <= MAX_BITS))
        .select("u", "v")
    )
    steps = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    points = held.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(steps).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    stars = points.groupBy("point").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return pairs.union(stars.select("u", F.explode("all").alias("v")).where("u <> v"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bucket: int = 64) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Equal fingerprints are one node from the start, so copies are never paired. Null and blank texts share
    fingerprint zero. A null id is never a component's name unless all its ids are null. Repeated rows are
    repeated in the result; other columns of ``docs`` are ignored; empty input gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprint-nodes", prints.count())
    roots = components(near_edges(nodes, bucket))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(best, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group, all columns."""
    kept = near_groups(docs, id_col, text_col, words).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col)
    return by_ids(docs, kept, id_col)
