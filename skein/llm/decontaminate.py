"""Benchmark decontamination with suffix arrays over the training text.

Each pass over about two megabytes of training text is a shard: its words that the benchmark also has are
numbered, their suffixes sorted by prefix doubling, and every benchmark suffix is binary-searched in the sorted
suffixes by its first ten words (suffixes that share them once), which gives the places of all matches that long. The
longest verbatim match from each place is the longest common prefix with any benchmark suffix. A word that the
benchmark lacks ends every match, so suffixes that start with one are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, byte_weights, lean, passes, spans, word_hashes, written

WINDOW = 10
#: Words of benchmark text that are searched together, and so broadcast; a larger benchmark is searched in blocks.
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 2 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


@dataclass
class Block:
    """The suffixes of some items. ``words``: sorted hashes of their vocabulary, whose word k is ``letters[bounds[k]:bounds[k + 1]]``; ``text``: word numbers from 1 of all items, zeros after each.

    ``windows``: the distinct first ``window`` words of the suffixes, 0-padded; window k is in ``items[first[k]:first[k + 1]]``.
    """

    weights: np.ndarray
    words: np.ndarray
    letters: np.ndarray
    bounds: np.ndarray
    text: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str | None]


def block_of(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Block | None:
    """None if no item has a word. Items shorter than a window are one whole suffix; longer ones have suffixes of a window or more."""
    names: list[str | None] = []
    found: dict[tuple[bytes, ...], dict[int, None]] = {}
    texts = []
    for name, text in items:
        words = _WORD.findall(text.lower())
        if not words:
            continue
        for k in range(max(1, len(words) - window + 1)):
            found.setdefault(tuple(words[k : k + window]), {})[len(names)] = None
        names.append(name)
        texts.append(words)
    if not found:
        return None
    vocabulary = sorted({w for x in texts for w in x})
    sizes = np.array([len(w) for w in vocabulary])
    data, ends = np.frombuffer(b"".join(vocabulary), np.uint8), np.cumsum(sizes)
    # Weights under which no two of these words collide.
    for seed in count(4):
        hashes = word_hashes(data, ends - sizes, ends, weights := byte_weights(seed))
        if len(np.unique(hashes)) == len(hashes):
            break
    order = np.argsort(hashes)
    number = {vocabulary[k]: rank + 1 for rank, k in enumerate(order.tolist())}
    windows = np.zeros((len(found), window), np.int64)
    for k, x in enumerate(found):
        windows[k, : len(x)] = [number[w] for w in x]
    text = np.array([n for x in texts for n in (*(number[w] for w in x), 0)], np.int64)
    shares = [len(x) for x in found.values()]
    return Block(
        weights, hashes[order], np.frombuffer(b"".join(vocabulary[k] for k in order.tolist()), np.uint8), np.concatenate([[0], np.cumsum(sizes[order])]), text,
        windows, np.array([len(x) for x in found]), np.cumsum([0, *shares]), np.array([i for x in found.values() for i in x]), names,
    )


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Positions of the non-zero numbers of ``text`` in the order of their suffixes' first ``longest`` numbers. ``text`` ends with ``longest`` zeros or more."""
    at = np.flatnonzero(text)
    rank, step = text, 1
    while True:
        size = int(rank.max(initial=0)) + 1
        key = rank[at] * size + rank[np.minimum(at + step, len(text) - 1)]
        _, dense = np.unique(key, return_inverse=True)
        rank = np.zeros(len(text), np.int64)
        rank[at] = dense + 1
        step *= 2
        if step >= longest:
            return at[np.argsort(dense, kind="stable")]


def search(text: np.ndarray, suffixes: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of ``suffixes`` that start with it, by two binary searches of all windows at once."""
    width = windows.shape[1]
    own = np.arange(width) < lengths[:, None]
    found = []
    for upper in (False, True):
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(suffixes))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            apart = np.where(own, text[suffixes[np.minimum(mid, len(suffixes) - 1)][:, None] + np.arange(width)] - windows, 0)
            sign = apart[np.arange(len(windows)), (apart != 0).argmax(axis=1)]
            right = (sign < 0) | upper & (sign == 0)
            low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
        found.append(low)
    return found[0], found[1]


def longest_matches(text: np.ndarray, at: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The longest run of words from each place of ``text`` that one item has too (zeros end every run).

    The suffixes of the spans behind these places and of the items are sorted together by prefix doubling; the
    longest common prefix with any item's suffix is that with the nearest one before or after, and the ranks of
    all doubling steps tell its length.
    """
    joint = np.concatenate([items, text, [0]])
    here = np.concatenate([np.flatnonzero(items), len(items) + np.flatnonzero(text)])
    rank = np.zeros(len(joint), np.int64)
    rank[here] = joint[here]
    levels, step = [rank], 1
    while len(np.unique(rank[here])) < len(here) and (rank[np.minimum(here + step, len(joint) - 1)] > 0).any():
        key = rank[here] * (int(rank.max()) + 1) + rank[np.minimum(here + step, len(joint) - 1)]
        rank = np.zeros(len(joint), np.int64)
        rank[here] = np.unique(key, return_inverse=True)[1] + 1
        levels.append(rank)
        step *= 2
    order = here[np.argsort(rank[here], kind="stable")]
    of_item = np.where(order < len(items), np.arange(len(order)), -1)
    before = np.maximum.accumulate(of_item)
    after = len(order) - 1 - np.maximum.accumulate(np.where(of_item >= 0, len(order) - 1 - np.arange(len(order)), -1)[::-1])[::-1]
    place = np.zeros(len(joint), np.int64)
    place[order] = np.arange(len(order))
    # Equal ranks also stand for runs that end alike, so a run counts no further than its own end.
    ends = np.flatnonzero(joint == 0)
    spot = len(items) + at
    most = ends[np.searchsorted(ends, spot)] - spot
    out = np.zeros(len(at), np.int64)
    for near in (before, after):
        found = near[place[spot]]
        some = (found >= 0) & (found < len(order))
        p, q, n = spot[some], order[found[some]], np.zeros(int(some.sum()), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][p] == levels[k][q]) & (levels[k][p] > 0)
            n, p, q = n + (same << k), np.minimum(p + (same << k), len(joint) - 1), np.minimum(q + (same << k), len(joint) - 1)
        out[some] = np.maximum(out[some], np.minimum(n, most[some]))
    return out


def _true_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, block: Block) -> np.ndarray:
    """Whether these words have the bytes of the vocabulary's words (numbered from 0) whose hashes they have."""
    own = np.diff(block.bounds)[words] == sizes
    at = np.flatnonzero(own)
    within = np.arange(int(sizes[at].sum())) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
    differ = data[np.repeat(starts[at], sizes[at]) + within] != block.letters[np.repeat(block.bounds[words[at]], sizes[at]) + within]
    own[np.repeat(at, sizes[at])[differ]] = False
    return own


def _ranges(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)


def _shard(data: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: words; of each match: document, first word in it, window, and the words that it goes on verbatim with an item."""
    folded = _FOLD[data]
    starts, ends, first = spans(folded, offsets, _INSIDE)
    n_words = np.diff(first)
    hashes = word_hashes(folded, starts, ends, block.weights)
    at = np.minimum(np.searchsorted(block.words, hashes), len(block.words) - 1)
    known = block.words[at] == hashes
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(starts)) + doc
    while True:
        text = np.zeros(len(starts) + len(n_words) + block.windows.shape[1] + 1, np.int64)
        text[place[known]] = at[known] + 1
        suffixes = suffix_array(text, block.windows.shape[1])
        none = np.zeros(0, np.int64)
        if not len(suffixes):
            return n_words, none, none, none, none
        low, high = search(text, suffixes, block.windows, block.lengths)
        window = np.repeat(np.arange(len(low)), high - low)
        where = suffixes[_ranges(low, high - low)]
        inside = np.zeros(len(text) + 1, np.int64)
        np.add.at(inside, where, 1)
        np.add.at(inside, where + block.lengths[window], -1)
        inside = np.cumsum(inside)[:-1] > 0
        # Words of matches are compared by their bytes; a word that only has a known word's hash is unknown.
        words = np.flatnonzero(inside[place])
        false = words[~_true_words(folded, starts[words], ends[words] - starts[words], at[words], block)]
        if not len(false):
            break
        known[false] = False
    if not len(where):
        return n_words, none, none, none, none
    order = np.argsort(where, kind="stable")
    where, window = where[order], window[order]
    # Only words that stand in matches, with one end between spans, are sorted among the items' suffixes.
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    shorter = np.cumsum(kept) - 1
    spot, back = np.unique(where, return_inverse=True)
    longest = longest_matches(np.where(inside, text, 0)[kept], shorter[spot], block.text)[back]
    doc_start = first[:-1] + np.arange(len(n_words))
    own = np.searchsorted(doc_start, where, "right") - 1
    return n_words, own, where - doc_start[own], window, longest


def _merge(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans of words from the starts, in order, and ends of matches."""
    out: list[tuple[int, int]] = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Block]:
    held, size = [], 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        text = bytes(text or b"")
        if held and size + len(text) // 2 > block_words:
            if block := block_of(held, window):
                yield block
            held, size = [], 0
        held.append((name, text))
        size += len(text) // 2
    if held and (block := block_of(held, window)):
        yield block


def _searched(shared: Broadcast, column: str) -> Callable[[pa.RecordBatch], Iterator[tuple[int, int, pa.Array, list, list, np.ndarray]]]:
    """For a batch's shards: first row, last row + 1, words, spans, items and longest match of each row."""

    def run(batch: pa.RecordBatch):
        block = shared.value
        for start, stop, data, offsets in passes(batch, column, SHARD_BYTES):
            if block is None:
                n_words = np.diff(spans(_FOLD[data], offsets, _INSIDE)[2])
                own = where = windows = longest = np.zeros(0, np.int64)
            else:
                n_words, own, where, windows, longest = _shard(data, offsets, block)
            rows: list = [[] for _ in n_words]
            items: list = [[] for _ in n_words]
            most = np.zeros(len(n_words), np.int32)
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(own))[: len(cuts)], strict=True):
                d = own[a]
                rows[d] = [{"first": x, "last": y - 1} for x, y in _merge(where[a:b], where[a:b] + block.lengths[windows[a:b]])]
                names = {block.names[i] for w in set(windows[a:b].tolist()) for i in block.items[block.first[w] : block.first[w + 1]]}
                items[d] = sorted(names - {None}) + [None] * (None in names)
                most[d] = longest[a:b].max()
            yield start, stop, n_words, rows, items, most

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: id, n_words, spans (of words first..last inside a window's occurrence), items (of the benchmark, with a window in it), longest (verbatim match with one item, in words).

    Words are runs of characters other than the ASCII ones that are neither letters nor digits, A-Z lower-cased.
    A window is ``window`` consecutive words of an item, or a shorter item whole. Null and empty texts have no
    words; items without words, or an empty benchmark, match nothing; equal item ids are one item, as are all
    without an id (null in ``items``); equal windows of several items count for each of them. Rows that repeat an
    id, or have none, are rows of their own; other columns are ignored. A block of ``block_words`` is what is
    broadcast; a larger benchmark is searched block by block over numbered rows, with the same result.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    id_type = slim.schema["_id"].dataType.simpleString()
    names = ["_row", "_id", "n_words", "spans", "items", "longest"]
    schema = f"_row long, _id {id_type}, n_words long, spans array<struct<first:int,last:int>>, items array<string>, longest int"

    def each(rows: DataFrame, block: Block | None) -> DataFrame:
        search_all = _searched(docs.sparkSession.sparkContext.broadcast(block), "_text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, stop, n_words, found, items, most in search_all(batch):
                    same = [batch.column(2).slice(start, stop - start), batch.column(0).slice(start, stop - start)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(n_words, pa.int64()), pa.array(found, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string())), pa.array(most)], names)

        return bounded_batches(rows).mapInArrow(lean(run), schema)

    blocks = _blocks(benchmark, item_col, text_col, window, block_words)
    one, more = next(blocks, None), next(blocks, None)
    if more is None:
        return each(slim.withColumn("_row", F.lit(0).cast("long")), one).drop("_row").withColumnRenamed("_id", id_col)
    # Written once, so that a row has the same number for every block.
    rows = written(slim.withColumn("_row", F.monotonically_increasing_id()), "benchmark-rows")
    found = reduce(DataFrame.union, [each(rows, block) for block in chain((one, more), blocks)])
    together = found.groupBy("_row").agg(
        F.first("_id").alias("_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
    )
    # Spans of several blocks that meet are one: they come in the order of their starts.
    joined = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<first:int,last:int>>)"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (x["first"] <= F.element_at(out, -1)["last"] + 1),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["last"], x["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(out, F.array(x))),
    )
    return together.select(F.col("_id").alias(id_col), "n_words", joined.alias("spans"), "items", "longest")


def n_hit(spans_col: str = "spans"):
    return F.aggregate(spans_col, F.lit(0).cast("long"), lambda n, x: n + (x["last"] - x["first"] + 1))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any word inside a benchmark window, with all their columns, whatever their names. One narrow pass for each block of the benchmark.

    Each row is judged by its own text: rows that repeat an id, or have none, don't share a verdict. Null and empty texts stay.
    """
    out = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    column = f"c{docs.columns.index(text_col)}"
    for block in _blocks(benchmark, item_col, text_col, window, block_words):
        search_all = _searched(docs.sparkSession.sparkContext.broadcast(block), column)

        def run(batches: Iterator[pa.RecordBatch], search_all=search_all) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, stop, _, found, *_ in search_all(batch):
                    yield batch.slice(start, stop - start).filter(pa.array([not x for x in found], pa.bool_()))

        out = bounded_batches(out).mapInArrow(lean(run), out.schema)
    return out.toDF(*docs.columns)
