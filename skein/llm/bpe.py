"""Byte-level BPE: a hierarchical-bitmap rank queue merges each pre-token."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, lean

#: Entries and bytes past which a memo of a Python worker starts anew, so memory stays bounded on any input.
MEMO = 200_000
MEMO_BYTES = 16 << 20
#: Longer items (in bytes) are never kept: texts without blanks are one item each, and hardly come again.
MEMO_ITEM = 1024

#: Bytes of text that are looked up and merged together.
PART_BYTES = 4 << 20
#: Rows of an Arrow batch: some parts' worth of ordinary texts (a batch's bytes are bounded as well).
BATCH_ROWS = 4000
#: Longer pre-tokens (in bytes) have a queue of their own; shorter ones share one.
LONG = 192
#: White space other than blank and line end (Unicode White_Space and the separators 1C to 1F).
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers that the splitter's tables have and Unicode 16, which the public encoder has, doesn't (first and last code point).
_NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
_SPACE_BYTE = _BLANK.copy()
_SPACE_BYTE[[ord(c) for c in _OTHER_SPACE if c.isascii()]] = True
_WIDE_SPACES = {n: [int.from_bytes(c.encode()) for c in _OTHER_SPACE if len(c.encode()) == n] for n in (2, 3)}
_UNKNOWN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _NEWER) + "]")
_BIT = [1 << k for k in range(4096)]


class RankQueue:
    """Ranks with entries: a bitmap of 256 ranks a word, and a bitmap of the words with any. Each rank has a bucket of entries."""

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The rank's bucket, from now on a queued one."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            w = rank >> 8
            self.words[w] = self.words.get(w, 0) | _BIT[rank & 255]
            self.top |= _BIT[w]
        return found

    def lowest(self) -> int:
        """The lowest queued rank, by find-first-set on either level; -1 for an empty queue."""
        if not self.top:
            return -1
        w = (self.top & -self.top).bit_length() - 1
        bits = self.words[w]
        return w << 8 | (bits & -bits).bit_length() - 1

    def drop(self, rank: int) -> list:
        w = rank >> 8
        self.words[w] ^= _BIT[rank & 255]
        if not self.words[w]:
            self.top ^= _BIT[w]
        return self.buckets.pop(rank)


@dataclass
class Ragged:
    """Lists of ids: list k is ``flat[ends[k]:ends[k + 1]]``."""

    flat: np.ndarray
    ends: np.ndarray

    def take(self, at: np.ndarray) -> Ragged:
        sizes = np.diff(self.ends)[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return Ragged(self.flat[np.arange(ends[-1]) + np.repeat(self.ends[at] - ends[:-1], sizes)], ends)

    def joined(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.ends, self.ends[-1] + other.ends[1:]]))


class Memo:
    """Ids of the items seen before. A memo past a bound starts anew from the items of the last part, so frequent ones stay."""

    def __init__(self) -> None:
        self.items = pa.array([], pa.binary())
        self.ids = Ragged(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def get(self, items: pa.Array, learn: Callable[[pa.Array], Ragged]) -> Ragged:
        place = _place(items, self.items)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.ids.take(place)
        fresh = items.take(pa.array(new))
        ids = learn(fresh)
        place[new] = len(self.items) + np.arange(len(new))
        out = self.ids.joined(ids).take(place)
        kept = _fitting(fresh)
        size = int(_offsets(self.items)[-1] + np.diff(_offsets(fresh))[kept].sum())
        if len(self.items) + len(kept) > MEMO or size > MEMO_BYTES:
            kept = _fitting(items)
            self.items, self.ids = items.take(pa.array(kept)), out.take(kept)
        elif len(kept):
            self.items, self.ids = pa.concat_arrays([self.items, fresh.take(pa.array(kept))]), self.ids.joined(ids.take(kept))
        return out


def _fitting(items: pa.Array) -> np.ndarray:
    """Places of the items that a memo may keep: the first short ones within its bounds."""
    sizes = np.diff(_offsets(items))
    short = np.flatnonzero(sizes <= MEMO_ITEM)[:MEMO]
    return short[np.cumsum(sizes[short]) <= MEMO_BYTES]


def _place(items: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each item among others, -1 for none."""
    return pc.fill_null(pc.index_in(items, value_set=among), -1).to_numpy().astype(np.int64)


def _offsets(items: pa.Array, own: bool = True) -> np.ndarray:
    """Where each item starts, and the end: within the items' own bytes, or within the buffer."""
    offsets = np.frombuffer(items.buffers()[1], np.int32, len(items) + 1 + items.offset)[items.offset :].astype(np.int64) if len(items) else np.zeros(1, np.int64)
    return offsets - offsets[0] if own else offsets


def _bytes(items: pa.Array) -> np.ndarray:
    """The items' bytes one after the other."""
    offsets = _offsets(items, False)
    return np.frombuffer(items.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)


def _array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The runs of bytes between consecutive offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _wide(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``size`` bytes from each place as one number, zero where they reach out of ``data``."""
    inside = (at >= 0) & (at + size <= len(data))
    out = np.zeros(len(at), np.int64)
    for k in range(size):
        out[inside] = out[inside] << 8 | data[at[inside] + k]
    return out


def _space_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character starts at each place."""
    out = _SPACE_BYTE[data[at]]
    some = np.flatnonzero(data[at] >= 0x80)
    for size, codes in _WIDE_SPACES.items():
        out[some] |= np.isin(_wide(data, at[some], size), codes)
    return out


def _space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character ends before each place."""
    out = _SPACE_BYTE[data[at - 1]]
    some = np.flatnonzero(data[at - 1] >= 0x80)
    for size, codes in _WIDE_SPACES.items():
        out[some] |= np.isin(_wide(data, at[some] - size, size), codes)
    return out


class Bpe:
    """A vocabulary of merge ranks (token bytes to rank, a rank being the token's id) and the pattern that cuts pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.unit = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.vocabulary = pa.array(ranks.keys(), pa.binary())
        self.vocabulary_ids = np.fromiter(ranks.values(), np.int32, len(ranks))
        self.place_of = np.full(max(ranks.values()) + 1, len(ranks), np.int32)
        self.place_of[self.vocabulary_ids] = np.arange(len(ranks))
        self.pieces = regex.compile(pattern).findall
        self.tokens, self.words = Memo(), Memo()

    @cached_property
    def pair_rank(self) -> dict[int, int]:
        """Ranks of all merges by the packed ids of their two tokens. Only encoding needs it."""
        ranks = self.ranks
        return {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    @cached_property
    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.fromiter(self.pair_rank.keys(), np.int64, len(self.pair_rank))
        order = np.argsort(pairs)
        return pairs[order], np.fromiter(self.pair_rank.values(), np.int64, len(pairs))[order]

    @cached_property
    def byte_pairs(self) -> np.ndarray:
        """Ranks of the merges of two bytes."""
        return np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merges of token pairs, -1 for pairs without."""
        pairs, ranks = self.pair_table
        key = a << 32 | b
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, ranks[at], -1)

    def cut(self, text: str) -> list[str]:
        """Pre-tokens. Characters that the public encoder doesn't know are cut as a private one, neither letter nor number."""
        if text.isascii() or not _UNKNOWN.search(text):
            return self.pieces(text)
        out, at = [], 0
        for piece in self.pieces(_UNKNOWN.sub("\ue000", text)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def merge(self, token: bytes) -> tuple[int, ...]:
        """Ids of one long pre-token: of all adjacent pairs the lowest rank merges first, the leftmost of equal ranks.

        Positions are links of a doubly linked list. Each is entered once at the start and at most twice a
        merge; an entry whose pair has changed since is stale and skipped.
        """
        if token in self.ranks:
            return (self.ranks[token],)
        n, rank_of = len(token), self.pair_rank
        ids = [int(self.unit[b]) for b in token]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        fresh = [(k, k + 1) for k in range(n - 1)]
        while True:
            for k, right in fresh:
                rank = rank_of.get(ids[k] << 32 | ids[right], -1)
                if rank >= 0:
                    heappush(queue.bucket(rank), k)
            fresh = []
            rank = queue.lowest()
            if rank < 0:
                return tuple(x for x in ids if x >= 0)
            k = heappop(queue.buckets[rank])
            if not queue.buckets[rank]:
                queue.drop(rank)
            gone = after[k]
            if ids[k] < 0 or gone >= n or rank_of.get(ids[k] << 32 | ids[gone]) != rank:
                continue
            ids[k], ids[gone] = rank, -1
            right = after[k] = after[gone]
            if right < n:
                before[right] = k
                fresh.append((k, right))
            if before[k] >= 0:
                fresh.append((before[k], k))

    def merge_all(self, data: np.ndarray, sizes: np.ndarray) -> Ragged:
        """Ids of many pre-tokens (their bytes one after the other) through one queue over all their positions.

        A step takes the lowest rank of all and merges it at the leftmost live position of every pre-token that
        has one, so each pre-token sees the order of its own queue; its further positions of that rank stay
        queued. A merge may queue a lower rank, which then comes first.
        """
        n = int(sizes.sum())
        ids = self.unit[data]
        of = np.repeat(np.arange(len(sizes)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last, first = np.cumsum(sizes) - 1, np.cumsum(sizes) - sizes
        after[last], before[first] = -1, -1
        current = np.full(n, -1)
        queue = RankQueue()

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            current[at] = ranks
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if len(ranks) == 1:
                queue.bucket(int(ranks[0])).append(at)
            elif len(ranks):
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for rank, part in zip(ranks[[0, *cuts]].tolist(), np.split(at, cuts), strict=True):
                    queue.bucket(rank).append(part)

        left = np.flatnonzero(after >= 0)
        enter(left, self.byte_pairs[data[left], data[left + 1]])
        while (rank := queue.lowest()) >= 0:
            held = queue.drop(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[current[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                lead = np.ones(len(at), bool)
                lead[1:] = of[at[1:]] != of[at[:-1]]
                if not lead.all():
                    queue.bucket(rank).append(at[~lead])
                    at = at[lead]
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone], current[gone] = rank, -1, -1
            after[at] = right
            some = right >= 0
            before[right[some]] = at[some]
            current[at[~some]] = -1
            prior = before[at]
            pairs = np.concatenate([at[some], prior[prior >= 0]])
            if len(pairs):
                enter(pairs, self.ranks_of(ids[pairs], ids[after[pairs]]))
        alive = ids >= 0
        return Ragged(ids[alive].astype(np.int32), np.concatenate([[0], np.cumsum(np.add.reduceat(alive, first))]))

    def learn_tokens(self, tokens: pa.Array) -> Ragged:
        """Ids of distinct pre-tokens."""
        rank = _place(tokens, self.vocabulary)
        sizes = np.diff(_offsets(tokens))
        out = np.where(rank >= 0, 1, 0)
        flat = [self.vocabulary_ids[rank[rank >= 0]]]
        order = [np.flatnonzero(rank >= 0)]
        long_ = np.flatnonzero((rank < 0) & (sizes > LONG))
        for k in long_.tolist():
            ids = self.merge(tokens[k].as_py())
            out[k] = len(ids)
            flat.append(np.array(ids, np.int32))
        order.append(long_)
        short = np.flatnonzero((rank < 0) & (sizes <= LONG))
        if len(short):
            some = tokens.take(pa.array(short))
            merged = self.merge_all(_bytes(some), sizes[short])
            out[short] = np.diff(merged.ends)
            flat.append(merged.flat)
            order.append(short)
        order = np.concatenate(order)
        mixed_ = Ragged(np.concatenate(flat), np.concatenate([[0], np.cumsum(out[order])]))
        return mixed_.take(np.argsort(order))

    def learn_words(self, words: pa.Array) -> Ragged:
        """Ids of distinct segments, each cut into pre-tokens. Segments that start with a lone blank and end without one are cut as one text."""
        data, offsets = _bytes(words), _offsets(words)
        head, tail = offsets[:-1], offsets[1:]
        lone = tail - head > 1
        lone[lone] = _BLANK[data[head[lone]]] & ~_space_at(data, head[lone] + 1) & ~_space_before(data, tail[lone])
        plain = words.filter(pa.array(lone))
        parts, counts = [], []
        if len(plain):
            raw, starts = _bytes(plain), _offsets(plain)
            pieces = self.cut(raw.tobytes().decode())
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            # From characters to bytes: a character starts at each byte that continues none.
            chars = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))
            ends = np.concatenate([[0], chars[ends]])
            parts.append(_array(raw, ends))
            counts.append(np.diff(np.searchsorted(ends, starts)))
        other = [[p.encode() for p in self.cut(w.as_py().decode())] for w in words.filter(pa.array(~lone))]
        parts.append(pa.array(list(chain.from_iterable(other)), pa.binary()))
        counts.append(np.fromiter(map(len, other), np.int64, len(other)))
        ids, at = self.known(self.tokens, pa.concat_arrays(parts), self.learn_tokens)
        out = ids.take(at)
        out.ends = out.ends[np.concatenate([[0], np.cumsum(np.concatenate(counts))])]
        return out.take(np.argsort(np.concatenate([np.flatnonzero(lone), np.flatnonzero(~lone)])))

    def known(self, memo: Memo, items: pa.Array, learn: Callable[[pa.Array], Ragged]) -> tuple[Ragged, np.ndarray]:
        """Ids of the distinct items, and the number of each item among them."""
        coded = items.dictionary_encode()
        return memo.get(coded.dictionary, learn), coded.indices.to_numpy()

    def encode_all(self, texts: pa.Array) -> Ragged:
        """Ids of whole texts (binary, without nulls, in UTF-8).

        Texts are cut before each blank or line end that stands alone between other characters: a pre-token starts
        there, so the ids of a segment don't depend on its neighbours and are looked up once for all its occurrences.
        """
        data, offsets = _bytes(texts), _offsets(texts)
        blanks = np.flatnonzero(_BLANK[data])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        blanks = blanks[~edge[blanks] & ~edge[blanks + 1]]
        blanks = blanks[~_space_at(data, blanks + 1) & ~_space_before(data, blanks)]
        edge[blanks] = True
        starts = np.flatnonzero(edge)
        if len(starts) < 2:
            return Ragged(np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64))
        ids, at = self.known(self.words, _array(data, starts), self.learn_words)
        out = ids.take(at)
        return Ragged(out.flat, out.ends[np.searchsorted(starts, offsets)])

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of the ids of each row: the bytes of all tokens one after the other, cut at the rows' ends."""
        if not len(ids):
            return pa.array([b""] * (len(ends) - 1), pa.binary())
        tokens = self.vocabulary.take(pa.array(self.place_of[ids]))
        return _array(_bytes(tokens), _offsets(tokens)[ends])

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text.encode()], pa.binary())).flat.tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about PART_BYTES: (first row, texts in UTF-8). Null is empty."""
    texts = texts.fill_null(b"")
    try:
        texts.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.as_py().decode("utf-8", "replace").encode() for x in texts], pa.binary())
    offsets, first = _offsets(texts, False), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART_BYTES, "right")) - 1)
        yield first, texts.slice(first, last - first)
        first = last


@lru_cache(2)
def load(path: str, pattern: str) -> Bpe:
    """The vocabulary of a rank file (base64 token, blank, rank a line); loaded once a worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
    return Bpe(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` without its text column, with ``out_col`` array<int> and, if named, ``decoded_col`` binary: the bytes that these ids decode to.

    ``path`` names a file that every executor has (an installed package's). Special tokens are ordinary text.
    Null and empty texts have no ids; bytes that are no UTF-8 are read as U+FFFD; a text is encoded whole, whatever
    its length. Repeated rows and null ids stay rows of their own, an empty table gives an empty one, and columns of
    ``docs`` with the names of the new ones are replaced.
    """
    new = [out_col, *([decoded_col] if decoded_col else [])]
    rest = [c for c in docs.columns if c not in (text_col, *new)]
    text = F.col(text_col).cast("binary")
    slim = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)), text.alias("text"))
    names = [*(f"c{k}" for k in range(len(rest))), "ids", *(["bytes"] if decoded_col else [])]
    schema = ", ".join([*(f"c{k} {slim.schema[k].dataType.simpleString()}" for k in range(len(rest))), "ids array<int>", *(["bytes binary"] if decoded_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for first, texts in _parts(batch.column(len(rest))):
                found = bpe.encode_all(texts)
                columns = [pa.ListArray.from_arrays(pa.array(found.ends, pa.int32()), pa.array(found.flat))]
                if decoded_col:
                    columns.append(bpe.decode_all(found.flat, found.ends))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns[: len(rest)], *columns], names)

    return bounded_batches(slim, BATCH_ROWS).mapInArrow(lean(run), schema).toDF(*rest, *new)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``out_col`` binary (replacing a column of that name): the bytes of the ids. No ids, or null, give no bytes; an unknown id fails."""
    rest = [c for c in tokens.columns if c != out_col]
    at = rest.index(ids_col)
    slim = tokens.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)))
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(slim.schema)), "bytes binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            ids = batch.column(at)
            sizes = np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = bpe.decode_all(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "bytes"])

    return bounded_batches(slim).mapInArrow(lean(run), schema).toDF(*rest, out_col)
