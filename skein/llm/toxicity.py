"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to symbols. Sequential transducers for insults, threats, reported speech and negation are composed
into one machine, which rewrites the symbols of a clause into patterns: an insult, a slur that only tells when it comes
again, a verb of harm or a threat of it, each negated or reported. A transducer for targets then runs over its output
in both directions, since a target may stand before or after. Pattern weights are fitted on labelled rows around fixed
prior weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skein.llm.common import bounded_batches, lean, written

#: Labelled rows of each class that the lexicon and the weights are learnt from (those with the smallest hashes of their ids).
SAMPLE_ROWS = 3000
#: Stems that may enter the lexicon, and stems considered for it.
LEXICON, CANDIDATES = 400, 5000

#: Bytes of the longest text that is learnt from.
SAMPLE_BYTES = 1 << 18

#: Words of each symbol of the grammar, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons imbecile stupid scum trash worthless pathetic disgusting loser losers clown clowns vermin filth bastard jerk dumb scumbag lowlife degenerate "
    "dummkopf trottel versager abschaum widerlich abfall crétin imbécile ordure salaud minable dégoûtant estúpido imbécil escoria basura asqueroso inútil"
).split()
HARM = (
    "kill murder hurt destroy hang shoot stab strangle exterminate töten umbringen ermorden vernichten erschießen tuer assassiner détruire frapper pendre matar asesinar destruir golpear"
).split()
INTENTS = "will shall gonna going should must deserve deserves ought werde werden wirst soll sollte muss vais va allons doit devrait voy vamos debe debería".split()
TARGETS = (
    "you your yours yourself u he she they them him her his their these those we us du dich dir dein deine ihr euch sie er ihn ihnen tu te toi ton ta vous votre il elle ils elles leur "
    "tú ti tus usted ustedes él ella ellos ellas"
).split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't didn't cannot nicht kein keine nie niemals pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = (
    "said says say told wrote reported called quoted quote alleged claimed according sagte sagt schrieb berichtete nannte laut dit écrit raconte selon appelait dijo dice escribió según llamó"
).split()

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
SHORTEST, LONGEST = 3, 7


@dataclass
class Transducer:
    """A sequential transducer: ``step[state, symbol]`` is (next state, output symbol); other symbols pass and lead to ``idle(state)``."""

    step: dict = field(default_factory=dict)
    idle: dict = field(default_factory=dict)
    start: object = 0

    def run(self, state, symbol):
        return self.step.get((state, symbol)) or (self.idle.get(state, state), symbol)

    def then(self, other: Transducer, symbols: list[str]) -> Transducer:
        """The composition: what ``other`` makes of this machine's output. Its states are the reachable pairs."""
        start = (self.start, other.start)
        out, todo, seen = Transducer(start=start), [start], {start}
        while todo:
            state = a, b = todo.pop()
            for symbol in symbols:
                a2, middle = self.run(a, symbol)
                b2, last = other.run(b, middle)
                out.step[state, symbol] = (a2, b2), last
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out


def marker(trigger: str, mark: str, kinds: list[str], reach: int | None) -> Transducer:
    """Adds ``mark`` to each symbol of ``kinds`` within ``reach`` words after ``trigger``, or to the clause's end."""
    out = Transducer()
    far = reach or 1
    for state in range(far + 1):
        out.step[state, trigger] = far, trigger
        rest = state if reach is None else max(0, state - 1)
        out.idle[state] = rest
        if state:
            for kind in kinds:
                out.step[state, kind] = rest, f"{kind}{mark}"
    return out


def insult() -> Transducer:
    """Insults after an insult belong to it (a chain of them is one); a word between ends the chain."""
    out = Transducer(idle={0: 0, 1: 0})
    for state in (0, 1):
        out.step[state, "i"] = 1, "o" if state else "I"
        out.step[state, "w"] = 0, "W"
    return out


def threat() -> Transducer:
    """A verb of harm is a threat up to three words after an intent, else only harm."""
    out = Transducer(idle={k: max(0, k - 1) for k in range(4)})
    for state in range(4):
        out.step[state, "f"] = 3, "o"
        out.step[state, "k"] = max(0, state - 1), "T" if state else "K"
    return out


def marked(kinds: list[str], marks: str) -> list[str]:
    return [k + "".join(m for m, on in zip(marks, x, strict=True) if on) for k in kinds for x in product((0, 1), repeat=len(marks))]


#: What the lexicon gives: other words, insults, slurs, verbs of harm, intents, targets, negations, reports.
SYMBOLS = ["o", "i", "w", "k", "f", "u", "n", "r"]
KINDS = ["I", "W", "K", "T"]
PATTERNS = marked(KINDS, "rnu")
GRAMMAR = (
    insult()
    .then(threat(), SYMBOLS)
    .then(marker("r", "r", KINDS, None), SYMBOLS)
    .then(marker("n", "n", marked(KINDS, "r"), 3), SYMBOLS)
)
TARGET = marker("u", "u", marked(KINDS, "rn"), 4)
#: Prior weights: insults weigh as they stand, harm when it is a threat or has a target; reports and negations take back most of it.
_PLAIN, _REPORTED, _TARGETED = {"I": 3.5, "W": 3.0, "K": 0.8, "T": 1.5}, {"I": 1.5, "W": 1.0, "K": 0.5, "T": 0.5}, {"I": 0.5, "W": 0.5, "K": 1.0, "T": 2.0}
PRIOR = np.array([0.0 if "n" in p else _REPORTED[p[0]] if "r" in p else _PLAIN[p[0]] + ("u" in p) * _TARGETED[p[0]] for p in PATTERNS])
PRIOR_BIAS = -2.5


class Lexicon:
    """Word to symbol: whole words, stems (``stem*``) that learnt insults start with, and stems (``stem**``) of learnt slurs."""

    def __init__(self, learnt: list[str]):
        self.symbol = {w: s for words, s in ((INTENTS, "f"), (TARGETS, "u"), (NEGATIONS, "n"), (REPORTS, "r"), (HARM, "k"), (INSULTS, "i")) for w in words}
        self.symbol |= {w: "i" for w in learnt if not w.endswith("*")}
        self.stems = {w.rstrip("*"): "w" if w.endswith("**") else "i" for w in sorted(learnt) if w.endswith("*")}
        self.sizes = sorted({len(w) for w in self.stems})
        self.memo: dict[str, str] = {}

    def of(self, word: str) -> str:
        found = self.memo.get(word)
        if found is None:
            stems = {self.stems.get(word[:k]) for k in self.sizes if k <= len(word)}
            found = self.symbol.get(word) or ("i" if "i" in stems else "w" if "w" in stems else "o")
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = found
        return found

    def patterns(self, clause: list[str]) -> list[str]:
        """The patterns of a clause of symbols."""
        state, out = GRAMMAR.start, []
        for symbol in clause:
            state, last = GRAMMAR.run(state, symbol)
            out.append(last)
        for _ in range(2):
            state, both = TARGET.start, []
            for symbol in out:
                state, last = TARGET.run(state, symbol)
                both.append(last)
            out = both[::-1]
        return [x for x in out if x[0] in KINDS]

    def features(self, text: str) -> list[tuple[int, float]]:
        """(number of a pattern, its weight in a whole text): clauses with it, three at most; of slurs, those after the first in a hundred words, four at most."""
        text = text.lower()
        if not any(self.of(w) in "iwk" for w in set(_WORD.findall(text))):
            return []
        counts: dict[int, int] = {}
        n_words = 0
        for clause in _CLAUSE.split(text):
            symbols = [self.of(w) for w in _WORD.findall(clause)]
            n_words += len(symbols)
            if "i" in symbols or "w" in symbols or "k" in symbols:
                seen = self.patterns(symbols)
                for p in [*{x for x in seen if x[0] != "W"}, *(x for x in seen if x[0] == "W")]:
                    counts[PATTERN_AT[p]] = counts.get(PATTERN_AT[p], 0) + 1
        slurs = sum(n for k, n in counts.items() if PATTERNS[k][0] == "W")
        share = min(4.0, 100.0 * (slurs - 1) / n_words) / slurs if slurs else 0.0
        return sorted((k, n * share if PATTERNS[k][0] == "W" else float(min(n, 3))) for k, n in counts.items())


PATTERN_AT = {p: k for k, p in enumerate(PATTERNS)}


@dataclass
class ToxicityModel:
    learnt: list[str]
    weights: np.ndarray
    bias: float

    def score(self, features: list[tuple[int, float]]) -> float:
        x = self.bias + sum(self.weights[k] * n for k, n in features)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def stems_of(text: str) -> set[str]:
    """Words and stems (``stem*``) of a text, and stems that start several of its words (``stem**``)."""
    words = _WORD.findall(text.lower())
    out, once = set(words), set()
    for w in words:
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            stem = w[:k]
            if stem in once:
                out.add(f"{stem}**")
            once.add(stem)
    return out | {f"{s}*" for s in once}


def cover(rows: dict[int, set[str]], score: dict[str, tuple[int, int]], least: int) -> list[str]:
    """Stems that cover the toxic rows, greedily: next is the one in most uncovered rows, so copies of one text add one stem."""
    by: dict[str, set[int]] = {}
    for row, stems in rows.items():
        for s in stems:
            by.setdefault(s, set()).add(row)
    chosen: list[str] = []
    while by and len(chosen) < LEXICON:
        best = max(by, key=lambda s: (len(by[s]), -score[s][1], len(s), s))
        gain = by[best]
        if len(gain) < least:
            break
        chosen.append(best)
        gain = set(gain)
        by = {s: left for s, x in by.items() if (left := x - gain)}
    return chosen


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns from at most ``sample_rows`` labelled rows of either class, of at most SAMPLE_BYTES each. Without labelled rows the prior lexicon and weights stand.

    Null labels are left out; an id with several labels counts as toxic if one says so; of rows that repeat an id
    some may be learnt from, within the bound. A stem becomes an insult if nearly all sampled rows with it are toxic,
    or a slur if nearly all rows with several words of it are, and if it covers toxic rows that no better stem covers.
    """
    of = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    first = lambda k: of.where(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # At most 2 * sample_rows ids: small enough to broadcast whatever the input.
    chosen = written(first(1).union(first(0)), "toxicity-sample")
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    met = slim.where(F.octet_length("_text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "_id")
    bounded = lambda k: met.where(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), F.xxhash64("_text")).limit(sample_rows)
    # Bounded in rows and bytes, so a fixed number of parts does.
    rows = written(bounded(1).union(bounded(0)), "toxicity-rows").repartition(12)
    n = dict(rows.groupBy("_toxic").count().collect())
    positives, negatives = n.get(1, 0), n.get(0, 0)
    if not positives or not negatives:
        return ToxicityModel([], PRIOR, PRIOR_BIAS)
    prior = Lexicon([])

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for s in stems_of(text.as_py()):
                    count.setdefault(s, [0, 0])[toxic] += 1
            some = [(s, a, b) for s, (a, b) in count.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.int64())], ["stem", "clean", "toxic"])

    least = max(2, round(0.003 * positives))
    counted = rows.select("_text", "_toxic").mapInArrow(lean(stems), "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = F.col("clean") / F.lit(float(negatives))
    # Rows with several words of a stem are fewer, and weigh by how many there are, so more clean ones may have them.
    most = F.when(F.col("stem").endswith("**"), F.lit(0.05)).otherwise(F.lit(0.02))
    strong = counted.where((F.col("toxic") >= least) & (rate <= most * F.col("toxic") / F.lit(float(positives)))).orderBy(F.desc("toxic"), "stem").limit(CANDIDATES)
    score = {r.stem: (r.toxic, r.clean) for r in strong.collect()}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            out = [[] if any(prior.of(w) == "i" for w in _WORD.findall(t.lower())) else sorted(stems_of(t) & score.keys()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["stems"])

    toxic_rows = rows.where("_toxic = 1").select("_text").mapInArrow(lean(held), "stems array<string>").where(F.size("stems") > 0)
    learnt = cover({k: set(r.stems) for k, r in enumerate(toxic_rows.collect())}, score, least) if score else []
    lexicon = Lexicon(learnt)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [lexicon.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([[k for k, _ in x] for x in each], pa.list_(pa.int32())), pa.array([[round(c, 3) for _, c in x] for x in each], pa.list_(pa.float64())), batch.column(1)], ["at", "n", "toxic"])

    data = rows.select("_text", "_toxic").mapInArrow(lean(features), "at array<int>, n array<double>, toxic int").groupBy("at", "n", "toxic").count().orderBy("at", "n", "toxic").collect()
    x = np.zeros((len(data), len(PATTERNS)))
    for k, r in enumerate(data):
        x[k, r.at] = r.n
    y, m = np.array([r.toxic for r in data], float), np.array([r["count"] for r in data], float)
    return ToxicityModel(learnt, *_fit(x, y, m))


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 60, tie: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, pulled towards the prior weights; patterns without rows keep them. Classes weigh the same."""
    n = np.where(y > 0, n / (2 * n[y > 0].sum()), n / (2 * n[y == 0].sum())) * n.sum()
    full = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(PRIOR, PRIOR_BIAS)
    w, pull = prior.copy(), np.append(np.full(len(PRIOR), tie), 0.1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (n * (p - y)) + pull * (w - prior)
        hess = (full * (n * p * (1 - p))[:, None]).T @ full + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def _each(docs: DataFrame, model: ToxicityModel, text_col: str, keep_below: float | None, out_col: str | None) -> DataFrame:
    """Scores whole texts inside one map pass: rows below ``keep_below`` with their columns, whatever their names, or all rows with ``out_col``."""
    columns = [c for c in docs.columns if c != out_col]
    slim = docs.select(*(F.col(f"`{c}`") for c in columns)).toDF(*(f"c{k}" for k in range(len(columns))))
    at = columns.index(text_col)
    schema = StructType([*slim.schema.fields, *([StructField("score", DoubleType())] if out_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.learnt)
        for batch in batches:
            scores = np.array([model.score(lexicon.features(t.as_py() or "")) for t in batch.column(at)], float)
            if out_col:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])
            else:
                yield batch.filter(pa.array(scores < keep_below))

    return bounded_batches(slim).mapInArrow(lean(run), schema).toDF(*columns, *([out_col] if out_col else []))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col`` (0 to 1, replacing a column of that name). Null and empty texts get the score of a text without patterns; repeated rows and null ids stay rows of their own; no rows give none."""
    return _each(docs, model, text_col, None, out_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, each judged by its own text."""
    return _each(docs, model, text_col, threshold, None)
