"""Substring deduplication by suffix automata of reference shards.

A window is 13 consecutive words. Of the five-word runs in a window the one with the smallest hash is its anchor,
so equal windows have equal anchors. Anchors seen in one document only end there. Around the others, the words of
all windows of an anchor are a piece, and the distinct pieces of an anchor are a reference shard: they are fed to a
suffix automaton in the order of their smallest documents, each after being streamed through it for its matching
statistics, which name the first document of each window. Automata of the whole corpus would have to be broadcast
shard after shard to all documents, which grows with the square of the corpus; here each shard is sent only the
pieces that can match in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import byte_weights, mixed, passes, spans, word_hashes, written

WINDOW, ANCHOR = 13, 5
#: Bits of the broadcast filter of shared anchors: at most 16 MB whatever the input; fuller filters let more pieces through, never fewer.
FILTER_BITS = 1 << 27
#: Anchors with more distinct pieces are no shard for one task: their windows are grouped by Spark instead.
SHARD_PIECES = 4096
_SPACE = np.ones(256, bool)
_SPACE[[32, *range(9, 14)]] = False
_WEIGHTS = byte_weights(7)
_NONE = -(1 << 63)


class SuffixAutomaton:
    """An online suffix automaton of word sequences; each state keeps the document that its words first came from."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [_NONE]

    def _state(self, length: int, doc: int, after: dict, link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.doc.append(doc)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state of ``at``'s words and ``word``, split off where longer words share the state."""
        q = self.next[at][word]
        if self.length[q] == self.length[at] + 1:
            return q
        clone = self._state(self.length[at] + 1, self.doc[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while at >= 0 and self.next[at].get(word) == q:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        """Adds a sequence; documents come in ascending order."""
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, doc, {}, 0)
            while last >= 0 and word not in self.next[last]:
                self.next[last][word] = new
                last = self.link[last]
            if last >= 0:
                self.link[new] = self._split(last, word)
            last = new

    def first_documents(self, words: list[bytes], size: int) -> list[int | None]:
        """For each run of ``size`` words the first document that has it, by matching statistics cut to ``size``; None where no document has."""
        state = n = 0
        out: list[int | None] = []
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                n += 1
            while state and self.length[self.link[state]] >= size:
                state = self.link[state]
            n = min(n, size)
            if k >= size - 1:
                out.append(self.doc[state] if n == size else None)
        return out


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of the documents: anchor, document number, first window (as a word of its document), windows; then word starts and ends and documents' first words."""
    starts, ends, first = spans(data, offsets, _SPACE)
    n = len(starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.view(np.int64), none, none, none, starts, ends, first
    words = word_hashes(data, starts, ends, _WEIGHTS)
    with np.errstate(over="ignore"):
        runs = np.zeros(n - ANCHOR + 1, np.uint64)
        for k in range(ANCHOR):
            runs = runs * np.uint64(0x9FB21C651E98DF25) + words[k : n - ANCHOR + 1 + k]
        runs = mixed(runs)
    pick = np.lib.stride_tricks.sliding_window_view(runs, window - ANCHOR + 1).argmin(axis=1) + np.arange(n - window + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = doc[: n - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, starts, ends, first
    heads = np.ones(len(at), bool)
    heads[1:] = (pick[at[1:]] != pick[at[:-1]]) | (np.diff(at) != 1)
    h = np.flatnonzero(heads)
    counts = np.diff(np.append(h, len(at)))
    at = at[h]
    return runs[pick[at]].view(np.int64), doc[at], at - first[doc[at]], counts, starts, ends, first


def _piece_windows(piece: bytes, size: int) -> list[bytes]:
    words = piece.split(b" ")
    return [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]


def _shards(rows: Iterator[tuple[int, bytes, int]], size: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """First documents of the windows of each piece; rows (anchor, piece, smallest document) come ordered by anchor and document."""
    held: list[tuple[bytes, int]] = []
    now = None

    def ended():
        if len(held) == 1:
            piece, doc = held[0]
            yield now, piece, [doc] * (piece.count(b" ") + 2 - size)
            return
        automaton = SuffixAutomaton()
        for piece, doc in held:
            words = piece.split(b" ")
            yield now, piece, [doc if d is None else d for d in automaton.first_documents(words, size)]
            automaton.add(words, doc)

    for anchor, piece, doc in rows:
        if anchor != now and held:
            yield from ended()
            held = []
        now = anchor
        held.append((piece, doc))
    if held:
        yield from ended()


def _bitmap(hashes: DataFrame, column: str, most_bits: int) -> np.ndarray:
    """The low bits of all hashes as marks in a bitmap of 16 bits a row, at most ``most_bits``. Built by Spark, a word of it a row."""
    bits = min(most_bits, 1 << max(16, (16 * hashes.count()).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(bits - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    cells = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return table.view(np.uint64)


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & (len(table) * 64 - 1)
    return (table[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, filter_bits: int = FILTER_BITS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(_doc, _hash, runs): for each text (by id and XXH64 of its bytes) the windows that also start in a text of a smaller id.

    A run (at, mask) stands for the windows that start at word ``at`` + k for each bit k of ``mask``. Ids are
    integers; a null id counts as the smallest. A window has at most 64 words.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("_doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in passes(batch, "_text"):
                own, doc, *_ = _anchors(data, offsets, window)
                ids = batch.column(0).slice(start, stop - start).to_numpy()[doc]
                order = np.lexsort((ids, own))
                own, ids = own[order], ids[order]
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                tails = np.append(heads[1:], len(own)) - 1 if len(own) else heads
                yield pa.RecordBatch.from_arrays([pa.array(own[heads]), pa.array(ids[heads]), pa.array(ids[tails])], ["anchor", "low", "high"])

    seen = slim.mapInArrow(anchors, "anchor long, low long, high long").groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = written(seen.where("low < high").select("anchor"), "anchors")
    filter_ = spark.sparkContext.broadcast(_bitmap(shared, "anchor", filter_bits))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_.value
        for batch in batches:
            for start, stop, data, offsets in passes(batch, "_text"):
                own, doc, at, counts, starts, ends, first = _anchors(data, offsets, window)
                hit = np.flatnonzero(_marked(table, own))
                own, doc, at, counts = own[hit], doc[hit], at[hit], counts[hit]
                raw = data.tobytes()
                a, b = starts[first[doc] + at], ends[first[doc] + at + counts + window - 2]
                texts = [b" ".join(raw[x:y].split()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                rows = pa.array(doc + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(own), pa.array(at, pa.int32()), pa.array(texts, pa.binary())], ["_doc", "_hash", "anchor", "at", "piece"]
                )

    found = slim.select("_doc", "_text", F.xxhash64("_text").alias("_hash")).mapInArrow(pieces, "_doc long, _hash long, anchor long, at int, piece binary")
    found = written(found, "pieces")
    distinct = found.groupBy("anchor", "piece").agg(F.min("_doc").alias("low"))
    distinct = written(distinct, "distinct-pieces")
    large = written(distinct.groupBy("anchor").count().where(F.col("count") > shard_pieces).select("anchor"), "large-anchors")
    some = not large.isEmpty()
    ordinary = distinct.join(large, "anchor", "left_anti") if some else distinct

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((a, p, d) for batch in batches for a, p, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        out: list[tuple[int, bytes, list[int]]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["anchor", "piece", "lows"])
        for row in _shards(rows, window):
            out.append(row)
            if len(out) >= 5000:
                yield pack()
                out = []
        if out:
            yield pack()

    lows = ordinary.repartition("anchor").sortWithinPartitions("anchor", "low", "piece").mapInArrow(match, "anchor long, piece binary, lows array<long>")
    lows = lows.select("anchor", F.xxhash64("piece").alias("_piece"), "lows")
    placed = found.select("_doc", "_hash", "at", "anchor", F.xxhash64("piece").alias("_piece"))
    # A piece is named by 128 bits, its anchor's hash and its own; a set bit is a window that an earlier document has.
    bits = F.transform("lows", lambda x, k: F.when(x < F.col("_doc"), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    mask = F.aggregate(bits, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))
    hits = placed.join(lows, ["anchor", "_piece"]).select("_doc", "_hash", "at", mask.alias("mask")).where("mask <> 0")
    if some:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = [_piece_windows(p, window) for p in batch.column(4).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
                at = np.concatenate([a + np.arange(len(x)) for a, x in zip(batch.column(3).to_pylist(), each, strict=True)]) if each else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array([w for x in each for w in x], pa.binary())], ["_doc", "_hash", "at", "window"])

        of = found.join(large, "anchor", "left_semi").select("_doc", "_hash", "anchor", "at", "piece").mapInArrow(windows, "_doc long, _hash long, at int, window binary")
        least = of.groupBy("window").agg(F.min("_doc").alias("low"))
        hits = hits.union(of.join(least, "window").where("low < _doc").select("_doc", "_hash", "at", F.lit(1).cast("long").alias("mask")))
    return hits.groupBy("_doc", "_hash").agg(F.collect_set(F.struct("at", "mask")).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **settings) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_text (binary: kept words joined by one space), removed (spans of words first..last).

    Each word that a window covers whose words also start in a document of a smaller id is removed; windows are
    judged on the input. Words are runs without ASCII white space, unchanged. Null texts have no words; texts
    of fewer than ``window`` words keep all; rows that repeat an id are judged alike, never against each other.
    """
    repeats = written(repeated_windows(docs, id_col, text_col, window, **settings), "repeats")
    filter_ = docs.sparkSession.sparkContext.broadcast(_bitmap(repeats.select("_hash"), "_hash", settings.get("filter_bits", FILTER_BITS)))
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    slim = slim.select("_id", "_text", F.coalesce(F.col("_id").cast("long"), F.lit(_NONE)).alias("_doc"), F.xxhash64("_text").alias("_hash"))
    kind = slim.schema["_id"].dataType.simpleString()
    names = ["_id", "n_words", "n_removed", "kept_text", "removed"]
    schema = f"_id {kind}, n_words long, n_removed long, kept_text binary, removed array<struct<first:int,last:int>>"

    def result(ids: pa.Array, texts: pa.Array, runs: list) -> pa.RecordBatch:
        n_words, n_removed, kept, removed = [], [], [], []
        for text, held in zip(texts, runs, strict=True):
            words = text.as_py().split()
            n_words.append(len(words))
            if not held:
                n_removed.append(0)
                kept.append(b" ".join(words))
                removed.append([])
                continue
            marks = np.array([(r["at"], r["mask"]) for r in held], np.int64)
            at = np.unique((marks[:, :1] + np.arange(window))[marks[:, 1:] >> np.arange(window) & 1 > 0])
            cover = np.zeros(len(words) + 1, np.int64)
            cover[at] += 1
            cover[at + window] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]))
            removed.append([{"first": a, "last": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, spans_type)], names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~_marked(filter_.value, batch.column(3).to_numpy())))
            yield result(batch.column(0), batch.column(1), [None] * batch.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(filter_.value, batch.column(3).to_numpy())))

    def removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch.column(0), batch.column(1), batch.column(2).to_pylist())

    # Texts without repeats need not meet the table of repeats: only those that a bounded filter can't rule out are shuffled.
    rows = slim.mapInArrow(touched, f"_id {kind}, _text binary, _doc long, _hash long").join(repeats, ["_doc", "_hash"], "left").select("_id", "_text", "runs")
    return slim.mapInArrow(untouched, schema).union(rows.mapInArrow(removing, schema)).withColumnRenamed("_id", id_col)
