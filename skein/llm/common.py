"""Shared helpers: cutting lineage, workers' memory, ASCII folding, and word tables over Arrow text."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.storage import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
PASS_BYTES = 1 << 20
LONG_WORD = 64


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: survives lost executors and is computed once.

    ``rows``: about how many narrow rows it has, to write a task a core or a million rows a task instead of one
    small file for each shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // 1_000_000))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, rows: int = 1000, size: str = "4m") -> DataFrame:
    """``df``, after lowering the session's bounds of Arrow batches: texts of hundreds of kilobytes in the usual 10,000 rows would fill a worker.

    A batch stands in the executor and in its worker, in buffers of up to twice its size and once more on its way back.
    """
    conf = df.sparkSession.conf
    held = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < held <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


_Map = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Of the GNU C library; others have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run: _Map) -> _Map:
    """``run`` of a mapInArrow, after whose batches freed memory goes back to the system.

    Workers are reused: what their allocators keep of one stage would stand beside the executor's memory in all later ones.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            _release()

    @wraps(run)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(released(batches))
        finally:
            _release()

    return each


def by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose id (null included) is among the first column of ``ids``, or with ``left_anti`` is not; ``docs`` may have columns of any names."""
    name = "_among"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return docs.join(ids.toDF(name).distinct(), F.col(id_col).eqNullSafe(F.col(name)), how)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null becomes the empty string."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def passes(batch: pa.RecordBatch, column: str, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` text bytes: (first row, last row + 1, bytes, offsets within these bytes). Null is empty."""
    text = batch.column(batch.schema.get_field_index(column))
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null(pa.scalar(b"", text.type) if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    n = len(text)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], kind, n + 1 + text.offset)[text.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs of bytes with ``inside[byte]``, never across documents: (starts, ends, first word of each document and the total)."""
    held = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = held[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = held[1:]
    starts = np.flatnonzero(held & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(held & ~(after & ~edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_weights(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, PASS_BYTES + 1), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        if n <= 8 * PASS_BYTES:
            _POWERS[base] = have
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte weights, by prefix sums, then mixed.

    Modulo 2**64 there are long words that collide under every such polynomial, so those of over LONG_WORD bytes
    have a BLAKE2 digest, keyed with the weights.
    """
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(weights[data] * _powers(_BASE, len(data))[: len(data)], out=sums[1:])
        own = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
        out = mixed(own + (ends - starts).astype(np.uint64))
    key = weights[:8].tobytes()
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=key).digest())
    return out
