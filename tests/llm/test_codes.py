"""Vector codes against plain integer rounds."""

import hashlib
import random

import numpy as np
import pytest

from skein.llm import codes, queries
from tests.compare import same_rows

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, ids int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, np.floor(4096 * np.array(v, np.float32).astype(float)).astype(int), label) for i, v, label, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, dim // parts)
    books = [x[:entries, k].copy() for k in range(parts)]

    def near(k):
        d = ((x[:, k][:, None] - books[k][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for k in range(parts):
            of = near(k)[0]
            for e in set(of.tolist()):
                own = x[of == e, k]
                books[k][e] = [int(s) // len(own) for s in own.sum(0)]
    found = [near(k) for k in range(parts)]
    error = sum(f[1] for f in found)
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{f[0][n]:02x}" for f in found), int(error[n]), by_label[r[2]], sha) for n, r in enumerate(kept)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("n", [3, 40, 700])
def test_codes_equal_plain_rounds(spark, tmp_path, n):
    rnd = np.random.default_rng(n)
    centres = rnd.normal(size=(6, 16)) * 0.3
    rows = [(int(k), [float(np.float32(x)) for x in centres[k % 6] + rnd.normal(size=16) * 0.05], [None, 0, 1, 2][k % 4]) for k in rnd.permutation(n)]
    rows += rows[:3] + [(None, rows[0][1], None), (None, [-0.5] * 16, 7), (9001, None, 1), (9002, [1.0, None] * 8, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] * 16, 1), (9005, [0.5] * 8, 1), (9006, [], 1)]
    rows += [(9100 + k, [0.25] * 16, 3) for k in range(n)]
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_trees_assign_as_all_distances_do():
    rnd = random.Random(3)
    for _ in range(60):
        dim, n, k = rnd.choice([1, 2, 8]), rnd.choice([1, 5, 16, 17, 300, 1000]), rnd.choice([1, 2, 16])
        gen = np.random.default_rng(rnd.randrange(1 << 30))
        x = gen.integers(-6, 7, (n, dim)) if rnd.random() < 0.5 else gen.integers(-4000, 4000, (n, dim))
        entries = np.concatenate([x[gen.integers(0, n, k)], x[:1]])
        tree = codes._unpacked(codes._packed(codes.grow(x)))
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        code, error = codes.nearest(tree, entries, n)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
        want = np.zeros((len(entries), dim + 1), int)
        np.add.at(want, d.argmin(1), np.column_stack([x, np.ones(n, int)]))
        assert (codes.sums(tree, entries) == want).all()


def test_whole_nodes_are_assigned_from_their_sums():
    x = np.concatenate([np.random.default_rng(0).integers(0, 50, (500, 4)) + s for s in (0, 9000)])
    found = list(codes.assign(codes.grow(x), np.array([[25] * 4, [9025] * 4])))
    assert sum(int(count.sum()) for _, _, _, count in found if count is not None) >= 950
    assert sum(len(at) for at, *_ in found) == len(codes.grow(x).points)


def test_empty_and_decoded(spark):
    empty, books = codes.compress(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error"]
    nothing = codes.compress(table(spark, [(1, [], 1), (2, [], None)]))[0]
    assert sorted((r.vec_id, r.code, r.error) for r in nothing.collect()) == [(1, [0] * 8, 0), (2, [0] * 8, 0)]
    rows = [(k, [float(k % 2), 0.5] * 8, 1) for k in range(40)]
    found, books = codes.compress(table(spark, rows))
    got = found.select("vec_id", "error", books.decoded("code").alias("v")).collect()
    assert all(r.error == 0 and r.v == [float(r.vec_id % 2), 0.5] * 8 for r in got)


def test_codes_equal_their_sql(spark, data, oracle):
    same_rows(queries.op12_vector_codes(spark, data), oracle, queries.oracle_sql()["op12_vector_codes"])
