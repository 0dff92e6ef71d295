"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from skein.llm import embeddings, queries
from tests.compare import same_rows

SCHEMA = "vec_id long, embedding array<float>, label int, root string, n_links int, node int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def brute(rows, cosine=0.98):
    good = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    vecs = [np.array(v, np.float32).astype(float) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    near = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(vecs[i]) == len(vecs[j]):
                x, y = vecs[i], vecs[j]
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    name = {}
    for i in range(len(rows)):
        if i not in name:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            name |= dict.fromkeys(seen, min(ids) if ids else None)
    return sorted(((r[0], len(near[i]), name[i], r[0] == name[i]) for i, r in enumerate(rows)), key=repr)


def made(seed, dim, n):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    rows = []
    for k in range(n):
        noise = rnd.choice([0.0, 0.02, 0.08, 0.1, 0.14, 0.2])
        v = centres[k % 12] + noise * rnd.normal(size=dim)
        rows.append((int(3 * n - k), [float(np.float32(x)) for x in v * rnd.choice([1.0, 1.0, 50.0])], [1, 1, 1, 2, None][k % 5]))
    chain = [np.array([np.cos(t), np.sin(t), *[0.0] * (dim - 2)]) for t in np.arange(40) * 0.19]
    rows += [(10_000 + k, [float(np.float32(x)) for x in v], 3) for k, v in enumerate(chain)]
    rows += rows[:9] + [(None, rows[0][1], 1), (None, None, 1), (20_000, None, 1), (20_001, [0.0] * dim, 1), (20_002, [1.0, None] * (dim // 2), 1), (20_003, [float("nan")] * dim, 1), (20_004, [], 1), (20_005, [1.0] * (dim + 1), 1), (20_006, [1.0] * (dim + 1), 1)]
    return rows


@pytest.mark.parametrize(("dim", "cell"), [(64, 2048), (20, 40), (8, 25), (4, 2048)])
def test_groups_equal_all_pairs(spark, tmp_path, dim, cell):
    rows = made(dim, dim, 240)
    held = table(spark, rows).repartition(3)
    got = embeddings.near_groups(held, cell=cell)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    if dim == 64:
        kept = embeddings.near_dedup(held)
        assert kept.columns == held.columns and {r.vec_id for r in kept.collect()} == {r[0] for r in brute(rows) if r[3]}


def test_pairs_at_the_threshold_share_a_block():
    rnd = np.random.default_rng(2)
    for dim in (3, 8, 17, 64):
        x = embeddings.units(rnd.normal(size=(2000, dim)))
        away = rnd.normal(size=(2000, dim))
        away -= (away * x).sum(1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * embeddings.units(away)
        a, b = (np.rint(embeddings.GRAIN * (v @ embeddings.rotation(dim))).astype(int) for v in (x, y))
        edges = embeddings.edges_of(dim)
        within = [((a - b)[:, lo:hi] ** 2).sum(1) <= embeddings.budget(hi - lo, dim, 0.98) for lo, hi in zip(edges, edges[1:], strict=False)]
        assert np.any(within, axis=0).all()


def test_no_vectors(spark):
    assert embeddings.near_groups(table(spark, [])).count() == 0
    assert [tuple(r) for r in embeddings.near_groups(table(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]


def test_groups_equal_their_sql(spark, data, oracle):
    same_rows(queries.op13_embedding_near_dedup(spark, data), oracle, queries.oracle_sql()["op13_embedding_near_dedup"])
