"""Cases in which an operator once did less than its whole job."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.llm import decontaminate, jaccard, lm_score, queries, toxicity
from skein.llm.simhash import fingerprint, shingle_hashes
from tests.llm.test_operators import EDGE, brute_contamination, brute_features, docs, rows_of

RND = random.Random(11)


def distinct_text(n):
    return " ".join(f"w{RND.randrange(10**6)}" for _ in range(n))


# pipeline: near copies


def brute_jaccard(texts, words=5):
    """Components of all pairs of five-word Jaccard >= 0.8, and the pairs; blank texts are one group."""
    sets = {i: frozenset(shingle_hashes((t or "").encode(), words).tolist()) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s or ["blank"]:
            holders[x].append(i)
    found = {p for v in holders.values() for p in combinations(sorted(v), 2)}
    near = [(a, b) for a, b in found if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, near


@pytest.mark.parametrize("bucket", [32, 2])
def test_near_copies_of_any_distance_are_found(spark, bucket):
    texts = [*EDGE, *EDGE]
    for size in (30, 100, 400):
        base = distinct_text(size).split()
        for k in range(25):
            words = list(base)
            for _ in range(k % 5 * size // 100 + k % 3):
                words[RND.randrange(size)] = distinct_text(1)
            texts.append(" ".join(words))
    texts += [f"{distinct_text(6)} {texts[-1]}" for _ in range(3)]
    table = docs(spark, texts)
    want, near = brute_jaccard(dict(enumerate(texts)))
    bits = [(fingerprint(shingle_hashes((texts[a] or "").encode(), 3)) ^ fingerprint(shingle_hashes((texts[b] or "").encode(), 3))) & (2**64 - 1) for a, b in near]
    assert sum(x.bit_count() > 2 for x in bits) > 20
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(table, bucket=bucket).collect()}
    assert got == want
    kept = jaccard.near_dedup(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert jaccard.near_groups(table.limit(0)).count() == 0


def test_pipeline_stage_leaves_no_near_copy(spark, data):
    import corpus_pipeline as p

    table = queries.table(spark, data, "documents")
    texts = {r.doc_id: r.text for r in table.collect()}
    want, near = brute_jaccard(texts)
    left = {r.doc_id for r in p.drop_near_copies(spark, table, data).collect()}
    assert left == set(want.values()) and len(near) > 0
    assert not [x for x in near if set(x) <= left]


# 4


def test_rows_that_share_an_id_keep_their_own_result_for_every_benchmark_size(spark):
    items = [(k, distinct_text(14)) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = [t.split() for _, t in items]
    texts = [f"{distinct_text(5)} {items[0][1]}", f"{items[1][1]} x {items[2][1]}", distinct_text(40), items[3][1], None, items[4][1], " ".join(words[0][:10] + words[5]), "", items[0][1]]
    # Matches with items of several blocks meet in one span.
    bench = bench.union(spark.createDataFrame([(9, " ".join(words[0][5:] + words[5][:5]))], bench.schema))
    items.append((9, " ".join(words[0][5:] + words[5][:5])))
    texts.append(" ".join(words[0] + words[5]))
    table = docs(spark, texts, [7, 7, 7, None, None, None, 1, 2, 7, 3])
    got = {n: rows_of(decontaminate.contamination(table, bench, block_words=n).withColumn("n", decontaminate.n_hit())) for n in (10**6, 30)}
    assert got[30] == got[10**6] and len(got[30]) == len(texts)
    seen = [(r[1], r[5], list(r[3])) for r in got[30]]
    assert sorted(seen) == sorted(brute_contamination(t, items) for t in texts)


# 10


def class_pairs(t):
    """(class of the word before, word) of each token of a text, words by their bytes."""
    words = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return [(int(lm_score.MARK) >> 48, None)]
    ends = np.cumsum([len(w) for w in words])
    hashes = lm_score.word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, lm_score._WEIGHTS)
    return list(zip([int(h) >> 48 for h in (lm_score.MARK, *hashes)], [*words, None], strict=True))


@pytest.mark.parametrize("hot", [1 << 18, 20])
def test_cross_entropy_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_score, "HOT", hot)
    texts = ["salt and iron Salt and stone", "salt and iron", None, "", "iron and salt é", "salt and iron", "中文 ab", "and salt iron", *["salt and"] * 12]
    ids = [0, 1, 2, 3, 4, 4, None, 7, *[8] * 12]
    table = docs(spark, texts, ids).withColumn("_id", F.lit(1)).withColumn("_target", F.lit("x"))
    good = spark.createDataFrame([(0, "x"), (1, "x"), (1, "y"), (None, "z"), (99, "w")], "doc_id long, text string")
    counts = []
    for corpus in (texts[:2], texts):
        pairs, classes = defaultdict(int), defaultdict(int)
        for c, w in (p for t in corpus for p in class_pairs(t)):
            pairs[c, w] += 1
            classes[c] += 1
        counts.append((pairs, classes))
    size = len({w for _, w in counts[1][0]})
    loss = lambda m, p: -np.log2((m[0][p] + 0.01) / (m[1][p[0]] + 0.01 * size))
    want = sorted((len(class_pairs(t)), *[float(np.mean([loss(m, p) for p in class_pairs(t)])) for m in counts]) for t in texts)
    got = lm_score.cross_entropy(table, good).collect()
    assert np.allclose(sorted((r.n_tokens, r.target_ce, r.background_ce) for r in got), want, atol=1e-4)
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, ids)) and all(abs(r.score - r.target_ce + r.background_ce) < 1e-12 for r in got)
    found = lm_score.totals(lm_score.with_target(table, good))
    assert bool(len(found.hot)) and lm_score.cross_entropy(table.limit(0), good).count() == 0
    assert all(abs(r.target_ce - np.log2(size)) < 1e-4 for r in lm_score.cross_entropy(table, good.limit(0)).collect())


@pytest.mark.parametrize("hot", [1 << 18, 20])
def test_rows_are_scored_by_the_others_counts(spark, monkeypatch, hot):
    """Each row against models fitted without it, one brute-force fit a row."""
    monkeypatch.setattr(lm_score, "HOT", hot)
    texts = ["salt and iron Salt and stone", "salt and iron", None, "iron and salt é", "salt and iron", "only here once", *["salt and"] * 12]
    good = {0, 1, 5}
    table = docs(spark, texts)
    size = len({w for t in texts for _, w in class_pairs(t)})
    want = []
    for k, t in enumerate(texts):
        row = [len(class_pairs(t))]
        for corpus in (good, set(range(len(texts)))):
            pairs, classes = defaultdict(int), defaultdict(int)
            for c, w in (p for j in corpus - {k} for p in class_pairs(texts[j])):
                pairs[c, w] += 1
                classes[c] += 1
            row.append(float(np.mean([-np.log2((pairs[p] + 0.01) / (classes[p[0]] + 0.01 * size)) for p in class_pairs(t)])))
        want.append(row)
    got = lm_score.cross_entropy(table, spark.createDataFrame([(k,) for k in good], "doc_id long"), leave_out=True).orderBy("doc_id").collect()
    assert np.allclose([(r.n_tokens, r.target_ce, r.background_ce) for r in got], want, atol=1e-4)
    assert lm_score.cross_entropy(table.limit(0), table.limit(0), leave_out=True).count() == 0


def test_op10_tells_phrases_apart(spark, data):
    """The query's tokens are words, so its model grows with the words of the documents."""
    texts = {r.doc_id: r.text for r in queries.table(spark, data, "documents").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op10_lm_score(spark, data).collect()}
    assert got == {i: len(shingle_hashes((t or "").encode(), 1)) + 1 for i, t in texts.items()}


# pipeline: tokens


def test_last_stage_states_the_round_trip(spark, data):
    import corpus_pipeline as p

    texts = [*EDGE, "don't  I'll\n\nx 中😀"]
    table = docs(spark, texts).withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    got = p.tokens(spark, table, data).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in enumerate(texts)}
    assert all(r.n_tokens == len(r.token_ids) for r in got)


def test_pipeline_stage_links_by_fingerprints_and_by_shingles(spark, data):
    """Texts of equal three-word shingles, and so of one fingerprint, whose five-word shingles differ; near copies of many bits; and both in a row."""
    import corpus_pipeline as p

    w = "cobalt".split()
    one, two = " ".join(w * 3), " ".join(w * 4)
    base = distinct_text(60)
    texts = [one, two, base, base + " tail", distinct_text(60), None, ""]
    table = docs(spark, texts)
    names, _ = brute_jaccard(dict(enumerate(texts)))
    assert names[1] == 1 and names[3] == 2
    bits = fingerprint(shingle_hashes(one.encode(), 3)) ^ fingerprint(shingle_hashes(two.encode(), 3))
    assert bits == 0
    kept = p.drop_near_copies(spark, table, data)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]
    assert p.drop_near_copies(spark, table.limit(0), data).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark, data):
    """Each stage by a plain version: clause scans, a dict of texts, all pairs by Jaccard, window sets, and the public encoder."""
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import corpus_pipeline as p

    docs_ = queries.table(spark, data, "documents")
    model = queries.toxicity_model(spark, docs_, data)
    lexicon = toxicity.Lexicon(model.learnt)
    weight = dict(zip(toxicity.PATTERNS, model.weights, strict=True))
    left = [(r.doc_id, r.text) for r in docs_.collect()]
    left = [(i, t) for i, t in left if model.bias + sum(weight[k] * v for k, v in brute_features(t or "", lexicon.of).items()) < 0]
    best = {}
    for i, t in left:
        k = (t or "").translate({c: c + 32 for c in range(65, 91)})
        best[k] = max(best.get(k, -1), i)
    left = [(i, t) for i, t in left if i in set(best.values())]
    names, _ = brute_jaccard(dict(left))
    left = [(i, t) for i, t in left if names[i] == i]
    items = [tuple(r) for r in queries.table(spark, data, "benchmark").collect()]
    left = [(i, t) for i, t in left if not brute_contamination(t, items)[1]]
    path, pattern = queries.tokenizer()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    assert {r.doc_id: r.token_ids for r in p.run(spark, data).collect()} == {i: other.encode_ordinary(t or "") for i, t in left}
    assert 0 < len(left) < docs_.count()
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "decontamination", "byte-level bpe"]


# pipeline: memory of Python workers


def test_workers_give_memory_back_between_stages(spark):
    import re
    from pathlib import Path

    import pyarrow as pa

    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")

    def own(batches):
        for _ in batches:
            pages = Path("/proc/self/smaps_rollup").read_text()
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", pages))) / 1024])], ["mb"])

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda k: F.concat(F.lit("word"), (F.col("id") * 7919 + k * k) % 99991)))
    rows = spark.range(0, 4000, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text"))
    items = spark.createDataFrame([("a", " ".join(f"word{k * k}" for k in range(1, 300)))], "item_id string, text string")
    for stage in (jaccard.near_groups(rows), decontaminate.decontaminate(rows, items)):
        stage.write.format("noop").mode("overwrite").save()
    held = [r.mb for r in spark.range(0, 4, numPartitions=4).mapInArrow(own, "mb double").collect()]
    assert max(held) < 150, held
