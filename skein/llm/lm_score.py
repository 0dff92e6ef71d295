"""Cross-entropy difference: matched word n-gram models of a target and a background corpus over one vocabulary.

Both are bigram models whose context is the class of the word before: P(word | class) = (n(class, word) + PRIOR) /
(n(class) + PRIOR * V), where V is the size of the vocabulary that they share. The totals of the classes are two arrays
of fixed size; the pairs of class and word, which grow with the corpora, are never gathered anywhere. Each document
sends its own distinct pairs to the tasks that count them, where both losses of a pair are known as soon as its
counts are, and the losses return to their documents as sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import bounded_batches, byte_weights, mixed, passes, spans, word_hashes, written

#: Count that every word has in advance after every class.
PRIOR = 0.01
#: Classes of context words, by the leading bits of their hashes.
CLASS_BITS = 16
#: A pair that makes up a share of 1 / HOT of all pairs of documents is hot; so there are at most so many, and their counts are broadcast.
HOT = 1 << 18
#: Pairs that a task counts to find hot ones before it forgets the rare ones. A hot pair that it misses is counted like any other.
POOL = 1 << 20
#: Bytes of an Arrow batch: repeats of a pair within one are one row, so smaller batches would send more rows.
BATCH_BYTES = "16m"
#: Bits of the filter of target ids (words of 64 bits, one a row, are broadcast: 2**18 at most).
FILTER_BITS = 1 << 24
#: Losses are summed as multiples of this part of a bit, so that sums don't depend on their order.
UNIT = 1 << 16
#: Words are runs of bytes that are not white space, A-Z lower-cased, by a 64-bit hash; this one stands for a text's bounds.
MARK = np.uint64(0x6A09E667F3BCC908)
_WEIGHTS = byte_weights(10)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_KIND = {"class": 0, "pair": 1, "all": 2}


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per pass: first row, last row + 1, row of each token within the pass, words, and classes of the words before. A row of n words has n + 1 tokens, the last one its end."""
    for first_row, last_row, data, offsets in passes(batch, "_text"):
        folded = _FOLD[data]
        starts, ends, first = spans(folded, offsets, _INSIDE)
        n = np.diff(first)
        rows = np.arange(len(n))
        words = np.full(len(starts) + len(n), MARK, np.uint64)
        words[np.arange(len(starts)) + np.repeat(rows, n)] = word_hashes(folded, starts, ends, _WEIGHTS)
        # The end of a text stands before the next one's first word.
        before = np.concatenate([[MARK], words[:-1]])
        yield first_row, last_row, np.repeat(rows, n + 1), words, (before >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _pairs(words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A key of 56 bits of each class and word (of 10**12 pairs one in 70,000 shares its key with another)."""
    with np.errstate(over="ignore"):
        return (mixed(words + (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)).view(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their sums, without those below ``least``."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)
    return found[sums >= least], sums[sums >= least]


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each row: row, key, count."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return rows[heads], keys[heads], np.diff(np.append(heads, len(rows)))


def _repeats(rows: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """How often each entry's key (below ``size``) occurs in its row."""
    _, at, n = np.unique(rows * size + keys, return_inverse=True, return_counts=True)
    return n[at]


@dataclass
class Totals:
    """``vocabulary``: distinct words, estimated by a sketch; ``target`` and ``background``: tokens after each class; ``hot``: sorted keys of hot pairs, ``hot_target`` and ``hot_background`` their counts."""

    vocabulary: int
    target: np.ndarray
    background: np.ndarray
    hot: np.ndarray
    hot_target: np.ndarray
    hot_background: np.ndarray


def with_target(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _target): whether a row's id is among ``target``'s. Null ids are not.

    A filter of fixed size is broadcast first; only texts that it can't rule out are joined, once.
    """
    ids = target.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    place = lambda: F.xxhash64("_id").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), place().bitwiseAND(F.lit(63).cast("long")).cast("int"))
    cells = ids.groupBy(F.shiftright(place(), 6).alias("_cell")).agg(F.bit_or(bit()).alias("_bits"))
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    tried = slim.withColumn("_cell", F.shiftright(place(), 6)).join(F.broadcast(written(cells, "target-filter")), "_cell", "left")
    may = F.coalesce(F.col("_bits"), F.lit(0).cast("long")).bitwiseAND(bit()) != 0
    # Merged at every size, so that the plan doesn't change where the labels outgrow a broadcast.
    held = ids.withColumn("_target", F.lit(True)).hint("merge")
    some = tried.where(may).select("_id", "_text").join(held, "_id", "left").select("_id", "_text", F.coalesce("_target", F.lit(False)).alias("_target"))
    return written(some, "target-texts").union(tried.where(~may).select("_id", "_text", F.lit(False)))


def totals(rows: DataFrame) -> Totals:
    """The totals of ``rows`` (_text, _target): target counts of the rows so marked, background counts of all."""
    size = 1 << CLASS_BITS

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, found, _ in _tokens(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found).view(np.int64))], ["word"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens after each class, of all rows and of the target's; pairs that many rows have; all distinct pairs of rows."""
        own, every, total = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, at, found, before in _tokens(batch):
                every += np.bincount(before, minlength=size)
                own += np.bincount(before[target[first + at]], minlength=size)
                seen, n = np.unique(_distinct(at, _pairs(found, before))[1], return_counts=True)
                total += int(n.sum())
                keys.append(seen)
                counts.append(n)
                if sum(map(len, keys)) > POOL:
                    keys, counts = [[x] for x in _summed(keys, counts, max(2, total / (4 * HOT)))]
        many, n = _summed(keys, counts, max(2, total / (4 * HOT)))
        here = np.flatnonzero(every)
        for kind, key, n, m in (("class", here, every[here], own[here]), ("pair", many, n, n * 0), ("all", np.zeros(1, np.int64), np.array([total]), np.zeros(1, np.int64))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), _KIND[kind], np.int32)), pa.array(key), pa.array(n), pa.array(m)], ["kind", "key", "n", "own"])

    slim = bounded_batches(rows.select("_text", "_target"), size=BATCH_BYTES)
    vocabulary = slim.mapInArrow(words, "word long").agg(F.approx_count_distinct("word", 0.01)).first()[0]
    seen = written(slim.mapInArrow(classes, "kind int, key long, n long, own long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("own").alias("own")), "class-totals")
    out = Totals(max(vocabulary, 1), np.zeros(size, np.int64), np.zeros(size, np.int64), *[np.zeros(0, np.int64)] * 3)
    held = seen.where(F.col("kind") == _KIND["class"]).toArrow()
    out.target[held.column("key").to_numpy()], out.background[held.column("key").to_numpy()] = held.column("own").to_numpy(), held.column("n").to_numpy()
    every = seen.where(F.col("kind") == _KIND["all"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out.hot = np.sort(seen.where((F.col("kind") == _KIND["pair"]) & (F.col("n") * HOT >= every)).select("key").toArrow().column("key").to_numpy())
    if len(out.hot):
        shared = rows.sparkSession.sparkContext.broadcast(out.hot)

        def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            own, every = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            for batch in batches:
                target = batch.column(1).to_numpy(zero_copy_only=False)
                for first, _, at, found, before in _tokens(batch):
                    keys = _pairs(found, before)
                    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    met = known[place] == keys
                    every += np.bincount(place[met], minlength=len(known))
                    own += np.bincount(place[met & target[first + at]], minlength=len(known))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(own), pa.array(every)], ["at", "own", "n"])

        held = slim.mapInArrow(hot, "at long, own long, n long").groupBy("at").agg(F.sum("own").alias("own"), F.sum("n").alias("n")).orderBy("at").toArrow()
        out.hot_target, out.hot_background = held.column("own").to_numpy(), held.column("n").to_numpy()
    return out


def cross_entropy(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, leave_out: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, target_ce, background_ce (mean loss in bits a token), score = target_ce - background_ce (low: like the target).

    The background corpus is all of ``docs``, the target corpus its rows whose id is in ``target``; whole texts count.
    Null and blank texts are one token, the end. Repeated rows and null ids are rows of their own and count as often
    as they occur. With ``leave_out`` each row is scored by the models of all other rows: what it adds itself to the
    counts of either corpus is taken off first, so rows of the target aren't favoured by their own words; its copies still
    count, and the vocabulary is that of all rows. Without target rows the target model is uniform; no rows give none. Other columns are ignored.
    """
    rows = with_target(docs, target, id_col, text_col)
    kind = rows.schema["_id"].dataType
    found = totals(rows)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row its distinct pairs that aren't hot, with their counts (negative in target rows), and one record of its tokens and of the losses known so far."""
        t = shared.value
        bits = lambda n: np.round(np.log2(n) * UNIT).astype(np.int64)
        size = [bits(n + prior * t.vocabulary) for n in (t.target, t.background)]
        hot = [bits(n + prior) for n in (t.hot_target, t.hot_background)]
        for batch in batches:
            target = batch.column(2).to_numpy(zero_copy_only=False)
            for first, last, at, words, before in _tokens(batch):
                keys = _pairs(words, before)
                place = np.minimum(np.searchsorted(t.hot, keys), max(len(t.hot) - 1, 0))
                met = t.hot[place] == keys if len(t.hot) else np.zeros(len(keys), bool)
                heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                known = []
                if leave_out:
                    own, pair = _repeats(at, before, 1 << CLASS_BITS), _repeats(at[met], place[met], max(len(t.hot), 1))
                    marked = target[first + at]
                    for n, m, share in ((t.target, t.hot_target, marked), (t.background, t.hot_background, np.ones(len(at), bool))):
                        loss = bits(n[before] - own * share + prior * t.vocabulary)
                        loss[met] -= bits(m[place[met]] - pair * share[met] + prior)
                        known.append(np.add.reduceat(loss, heads))
                else:
                    for s, h in zip(size, hot, strict=True):
                        loss = s[before]
                        loss[met] -= h[place[met]]
                        known.append(np.add.reduceat(loss, heads))
                tokens = np.diff(np.append(heads, len(at)))
                of, key, n = _distinct(at[~met], keys[~met])
                # Records of rows are spread over all tasks.
                head = mixed((batch.column(3).slice(first, last - first).to_numpy()).view(np.uint64)).view(np.int64)
                pick = first + np.concatenate([of, np.arange(last - first)])
                none = np.ones(len(of), bool)
                ids = batch.column(0).take(pa.array(np.where(np.arange(len(pick)) < len(of), -1, pick), mask=np.arange(len(pick)) < len(of)))
                record = [pa.array(np.concatenate([np.zeros(len(of), np.int64), x]), mask=np.append(none, np.zeros(last - first, bool))) for x in (tokens, *known)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([key, head])), batch.column(3).take(pa.array(pick)), ids, pa.array(np.concatenate([np.where(target[first + of], -n, n), np.zeros(last - first, np.int64)]), pa.int32()), *record],
                    ["key", "row", "id", "n", "tokens", "target", "background"],
                )

    numbered = bounded_batches(rows.withColumn("_row", F.monotonically_increasing_id()), size=BATCH_BYTES)
    sent = numbered.mapInArrow(pairs, f"key long, row long, id {kind.simpleString()}, n int, tokens long, target long, background long")
    # Rows that aren't records keep their nulls as one.
    sent = sent.select("key", "row", "n", F.when(F.col("tokens").isNotNull(), F.struct("id", "tokens", "target", "background")).alias("record"))
    of_pair = Window.partitionBy("key")
    counted = sent.select("row", "n", "record", F.sum(F.abs("n")).over(of_pair).alias("b"), F.sum(F.greatest(-F.col("n"), F.lit(0))).over(of_pair).alias("t"))

    def loss(name: str, count: str) -> Column:
        left = F.col(count) - ((F.abs("n") if count == "b" else F.greatest(-F.col("n"), F.lit(0))) if leave_out else F.lit(0))
        own = F.when(F.col("n") != 0, F.round(F.log2(left + F.lit(prior)) * F.abs("n") * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.sum(F.coalesce(F.col(f"record.{name}"), F.lit(0).cast("long")) - own)

    sums = counted.groupBy("row").agg(F.max("record.id").alias("id"), F.sum("record.tokens").alias("n_tokens"), loss("target", "t").alias("t"), loss("background", "b").alias("b"))
    mean = lambda c: F.col(c) / F.lit(float(UNIT)) / F.col("n_tokens")
    return sums.select(F.col("id").alias(id_col), "n_tokens", mean("t").alias("target_ce"), mean("b").alias("background_ce"), (mean("t") - mean("b")).alias("score"))
