"""URL filter: rules for hosts and paths, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LOWER, UPPER

#: The rules of the production filter (pattern, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: The labelled table. Each name stands for the hosts and paths that ``labelled_urls`` makes of it; no host of the given tables is named.
BLOCKED_NAMES = (
    "casino-online mega-casino best-casino casino-royal vegas-casino live-casino sports-bets bet-now betting betting-tips free-spins poker-room slots-jackpot lottery-win "
    "spam-links spam-mailer bulk-spam link-farm click-farm ad-tracker ads-server adserver ads-network click-ads popup-ads banner-ads track-pixel tracking-ads "
    "pills-online discount-pills diet-pills cheap-meds cheap-viagra viagra-shop pharmacy-deal adult-cams adult-video adult-dating adult-chat "
    "xxx-tube porn-hub sex-chat hot-cams nude-pics fast-loans payday-loan free-money free-gifts get-rich crypto-profit "
    "replica-watch fake-bags warez-crack keygen-serial torrent-crack malware-drop phish-login win-prize free-iphone miracle-diet"
).split()
ALLOWED_NAMES = (
    "news wiki docs library museum university school science nature history weather garden recipes travel music books journal archive "
    "research health parliament council hospital community forum support developer python-docs open-data city-guide city-news "
    "daily-post river mountain theatre orchestra football railway airport cooking photo-club bike-repair local-history "
    "weltbild bibliothek schule zeitung gemeinde musee ecole jardin cuisine journaux biblioteca escuela noticias ciudad jardines"
).split()
#: Names that mean nothing, of all pairs of these syllables: a host is no worse for being unknown.
SYLLABLES = "ba den fil gor ha jen kul lam mo nir pa rus sel tan vi wer".split()
BLOCKED_PATHS = "/casino/bonus /free-pills/buy /xxx/cams /bet/now /ads/track /win/prize".split()
ALLOWED_PATHS = "/ /en/123 /fr/42.html /de/page/7/ /es/articles/2020 /about /wiki/river /news/2021/05/city".split()

BUCKETS = 1 << 16
#: Scores from which the model blocks, and the share of urls taken to be bad, by which the two labels weigh.
THRESHOLD, BAD_SHARE = 0.5, 0.2
SIZES = (3, 4, 5)


def labelled_urls() -> list[tuple[str, str, int]]:
    """The small labelled table as (host, path, 1 for block): every name under the same prefixes and top-level names, so these tell nothing."""
    out = []
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for k, name in enumerate(names):
            for prefix, top in (("", "example.com"), ("www.", "example.net"), ("m.", "example.org"), ("blog.", "example.com"), ("", "com")):
                out.append((f"{prefix}{name}.{top}", ALLOWED_PATHS[(k + len(prefix)) % len(ALLOWED_PATHS)], label))
    out += [(f"{('www.', 'm.', '')[k % 3]}{a}{b}.example.{('org', 'net', 'com')[k // 3 % 3]}", ALLOWED_PATHS[k % len(ALLOWED_PATHS)], 0) for k, (a, b) in enumerate(product(SYLLABLES, repeat=2))]
    # The same hosts with a bad path and with a harmless one: only the path tells.
    for k, name in enumerate(ALLOWED_NAMES):
        host = f"{('www.', 'm.', '')[k % 3]}{name}.example.{('org', 'net', 'com')[k // 3 % 3]}"
        out += [(host, BLOCKED_PATHS[k % len(BLOCKED_PATHS)], 1), (host, ALLOWED_PATHS[k % len(ALLOWED_PATHS)], 0)]
    return out


def grams(host: str, path: str) -> list[int]:
    """Buckets of the distinct n-grams of host and of path, each with its ends marked."""
    out = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            out.update(f"{kind}{text[k : k + n]}" for k in range(max(1, len(text) - n + 1)))
    return [crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in out]


@lru_cache(1)
def fitted(steps: int = 300, rate: float = 1.0, tie: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent on the labelled table; rows have unit length, so long urls weigh like short ones."""
    rows = labelled_urls()
    cells = [grams(h, p) for h, p, _ in rows]
    y = np.array([label for *_, label in rows], float)
    of, at = np.repeat(np.arange(len(rows)), [len(c) for c in cells]), np.concatenate(cells)
    value = np.repeat([len(c) ** -0.5 for c in cells], [len(c) for c in cells])
    w, bias = np.zeros(BUCKETS), -1.0
    for _ in range(steps):
        z = np.bincount(of, w[at] * value, len(rows)) + bias
        miss = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, BAD_SHARE / y.sum(), (1 - BAD_SHARE) / (1 - y).sum())
        w -= rate * 10 * (np.bincount(at, miss[of] * value, BUCKETS) + tie * w / len(rows))
        bias -= rate * miss.sum()
    return w, bias


def score(host: str, path: str) -> float:
    """The probability that a url is to be blocked."""
    w, bias = fitted()
    cells = grams(host, path)
    return float(1 / (1 + np.exp(-(w[cells].sum() / len(cells) ** 0.5 + bias))))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end; both empty for null or no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, null where none does. A rule fits its host and all subdomains if the path starts with the rule's."""
    pattern = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        pattern, verdict = F.when(fits, F.lit(rule)).otherwise(pattern), F.when(fits, F.lit(says)).otherwise(verdict)
    return pattern, verdict


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict (the rule's, else ``block`` for a score of ``threshold`` or more), score.

    A null or malformed url has empty host and path and is judged by its score like any other. ``rules`` is a
    configured list that becomes one expression. Repeated rows and null ids are rows of their own; no rows give
    none; a url is judged whole, whatever its length; other columns of ``pages`` are ignored.
    """
    weights = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = weights
        for batch in batches:
            cells = [grams(h.as_py(), p.as_py()) for h, p in zip(batch.column(1), batch.column(2), strict=True)]
            z = [w[c].sum() / len(c) ** 0.5 + bias for c in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.array(z, float))))], ["_id", "host", "path", "score"])

    host, path = host_and_path(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    scored = slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, host string, path string, score double")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
