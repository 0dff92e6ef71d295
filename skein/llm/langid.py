"""Language identification: averaged hashed subword embeddings, a linear softmax trained by SGD, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, mixed

#: Labelled rows that the model is trained and calibrated on (those with the smallest hashes of their ids).
SAMPLE_ROWS = 3000
BUCKETS, WIDTH, SIZES = 1 << 16, 16, (1, 2, 3)
#: Bytes of the longest text that is learnt from; so the sample that reaches the driver is bounded in rows and bytes.
SAMPLE_BYTES = 1 << 16
#: Share of accepted predictions that the rejection threshold makes right on the calibration rows.
PRECISION = 0.99
PASS_CHARS = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the lower-cased texts and each text's first bucket (and the total): runs of one to three letters, with word ends as characters."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    codes = np.concatenate(parts)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), sizes)
    own, place = [], []
    for n in SIZES:
        last = len(codes) - n + 1
        key = np.full(last, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                key = key * np.uint64(0x100000001B3) + codes[k : k + last]
        holds = codes[:last] > 0 if n == 1 else (codes[1:last + 1] > 0) | (codes[:last] > 0) if n == 2 else codes[1 : last + 1] > 0
        holds = holds & (of[:last] == of[n - 1 :])
        own.append((mixed(key[holds]) % np.uint64(BUCKETS)).astype(np.int64))
        place.append(of[:last][holds])
    own, place = np.concatenate(own), np.concatenate(place)
    order = np.argsort(place, kind="stable")
    return own[order], np.searchsorted(place[order], np.arange(len(texts) + 1))


@dataclass
class LanguageModel:
    """``table``: logits of each bucket (embedding times softmax weights); a text's logits are its subwords' mean plus ``bias``, over ``temperature``."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text and whether it has a letter."""
        out, some = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        first = 0
        while first < len(texts):
            last, size = first + 1, len(texts[first])
            while last < len(texts) and size + len(texts[last]) <= PASS_CHARS:
                size += len(texts[last])
                last += 1
            cells, starts = subwords(texts[first:last])
            n = np.diff(starts)
            if len(cells):
                full = n > 0
                for c in range(len(self.languages)):
                    out[first:last, c][full] = np.add.reduceat(self.table[cells, c], starts[:-1][full], dtype=np.float64) / n[full]
            some[first:last] = n > 0
            first = last
        return out + self.bias, some

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        z, some = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[k] if s else "und" for k, s in zip(best, some, strict=True)], np.where(some, p.max(axis=1), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 9) -> LanguageModel:
    """SGD over four fifths of the rows; the rest set the temperature and the rejection threshold."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in languages])
    rows = []
    for t in texts:
        cells, _ = subwords([t])
        rows.append(np.unique(cells, return_counts=True))
    order = rng.permutation([k for k, (c, _) in enumerate(rows) if len(c)])
    held = order[: len(order) // 5]
    train = order[len(held) :]
    e, w, b = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, len(names))), np.zeros(len(names))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(train):
            cells, counts = rows[k]
            share = counts / counts.sum()
            x = share @ e[cells]
            miss = _softmax(x @ w + b)
            miss[label[k]] -= 1
            back = w @ miss
            w -= step * np.outer(x, miss)
            b -= step * miss
            # Rows of the mean move by their share; the factor makes steps as large as for single subwords.
            e[cells] -= step * np.outer(np.sqrt(share), back)
    model = LanguageModel(names, (e @ w).astype(np.float32), b, 1.0, 0.0)
    check = held if len(held) >= 20 else order
    if len(check):
        z, _ = model.logits([texts[k] for k in check])
        truth = label[check]
        losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(check)), truth], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(z / model.temperature)
        right, top = p.argmax(axis=1) == truth, p.max(axis=1)
        by = np.argsort(-top)
        share = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
        good = np.flatnonzero(share >= PRECISION)
        model.accept = float(top[by][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learns from at most ``sample_rows`` rows with text, of at most SAMPLE_BYTES, and language: those with the smallest hashes of id and text.

    Without such rows every prediction is ``und``. Repeated rows may be learnt from several times; null ids count like others.
    """
    some = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).where((F.octet_length("_t") <= SAMPLE_BYTES) & F.col("_l").isNotNull())
    # The hashes alone choose the rows, so texts aren't sorted; equal hashes are cut by the second limit.
    last = some.select(F.xxhash64("_i", "_t").alias("_h")).orderBy("_h").limit(sample_rows).agg(F.max("_h")).first()[0]
    rows = some.where(F.xxhash64("_i", "_t") <= last).orderBy(F.xxhash64("_i", "_t"), "_i", "_l").limit(sample_rows).collect() if last is not None else []
    return fit([r["_t"] for r in rows], [r["_l"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (calibrated probability), accepted (score reaches the rejection threshold).

    ``und`` with score 0 for null and for texts without a letter. Repeated rows and null ids are rows of their own; no
    rows give none; whole texts count; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                names, p = model.predict([t.as_py() or "" for t in part.column(1)])
                accepted = pa.array([n != "und" and x >= model.accept for n, x in zip(names, p, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(p), accepted], ["_id", "lang_pred", "score", "accepted"])

    kind = slim.schema["_id"].dataType.simpleString()
    return bounded_batches(slim).mapInArrow(run, f"_id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("_id", id_col)
