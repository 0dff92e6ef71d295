import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import gradient, subspace

RNG = np.random.default_rng(12)


def table(spark, x, target=None, y=None):
    rows = [(k, None if target is None else int(target[k]), None if y is None else float(y[k]), [float(v) for v in r]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "cycle_id long, target int, y double, features array<double>").repartition(3).persist()


def dual_hinge(x, s, box, sweeps=3000):
    """Dual coordinate ascent of the machine whose constant is one more weight."""
    one = np.column_stack([x, np.ones(len(x))])
    a, w, q = np.zeros(len(x)), np.zeros(one.shape[1]), (one**2).sum(axis=1)
    for _ in range(sweeps):
        for i in RNG.permutation(len(x)):
            new = np.clip(a[i] - (s[i] * (w @ one[i]) - 1) / q[i], 0, box)
            w, a[i] = w + (new - a[i]) * s[i] * one[i], new
    return w


def hinge_value(x, s, w, box):
    return w @ w / 2 + box * np.maximum(0, 1 - s * (x @ w[:-1] + w[-1])).sum()


def test_support_vectors_come_within_one_percent_of_a_dense_solver(spark):
    target = np.arange(90) % 3
    x = RNG.normal(size=(90, 4)) + 1.2 * np.eye(3)[target][:, [0, 1, 2, 0]]
    got = gradient.support_vectors(table(spark, x, target), box=2.0)
    for k, (a, b) in enumerate(got.pairs):
        own = (target == a) | (target == b)
        s = np.where(target[own] == a, 1.0, -1.0)
        assert hinge_value(x[own], s, got.weights[k], 2.0) <= 1.01 * hinge_value(x[own], s, dual_hinge(x[own], s, 2.0, 300), 2.0)
    pred = dict(table(spark, x, target).select("cycle_id", got.predict(F.col("features")).alias("p")).collect())
    assert np.mean([pred[k] == target[k] for k in range(90)]) > 0.7 and got.importance().shape == (4,)


def test_epsilon_insensitive_regression_ignores_small_errors_and_outliers(spark):
    x = RNG.normal(size=(120, 3))
    y = x @ [1.0, -2.0, 0.0] + 0.5 + RNG.uniform(-0.05, 0.05, 120)
    y[:6] += 50
    w = gradient.support_regression(table(spark, x, y=y), box=100.0, insensitive=0.1).weights
    assert np.allclose(w, [1, -2, 0, 0.5], atol=0.06)


def test_one_class_machine_leaves_about_its_share_outside(spark):
    x = np.abs(RNG.normal(2, 0.4, (200, 3)))
    model = gradient.one_class_machine(table(spark, x), 0.1, rounds=25)
    scores = np.array([r[0] for r in table(spark, np.vstack([x, [[0.0, 0.0, 0.1]]])).select(model.score(F.col("features")).alias("s"), "cycle_id").orderBy("cycle_id").collect()])
    assert 0.04 < (scores[:200] < 0).mean() < 0.16 and scores[200] < 0


def test_a_hidden_layer_learns_exclusive_or(spark):
    x = np.array([[a, b] for a in (0.0, 1.0) for b in (0.0, 1.0)] * 10)
    rows = table(spark, x, y=(x[:, 0] != x[:, 1]).astype(float))
    m = subspace.moments(rows, also=("y",))[()]
    few = [gradient.network(rows, m, (4,), seed=3, rounds=2).params for _ in range(2)]
    assert np.allclose(*few)
    one = gradient.network(rows, m, (4,), seed=3, rounds=50)
    got = rows.select("y", one.predict(F.col("features")).alias("p")).collect()
    assert max(abs(r.y - r.p) for r in got) < 0.1


def test_gradients_of_networks_follow_from_differences():
    net = gradient.Network([3, 4, 2, 1], RNG.normal(size=3 * 4 + 4 + 4 * 2 + 2 + 3), np.zeros(3), np.ones(3), np.zeros(1), np.ones(1))
    x, y = RNG.normal(size=(7, 3)), RNG.normal(size=7)
    _, g = net.loss(x, y, net.params)
    for k in range(len(g)):
        e = 1e-6 * (np.arange(len(g)) == k)
        assert g[k] == pytest.approx((net.loss(x, y, net.params + e)[0] - net.loss(x, y, net.params - e)[0]) / 2e-6, abs=1e-5)


def test_an_auto_encoder_scores_what_leaves_the_curve(spark):
    t = RNG.uniform(-1, 1, 150)
    rows = table(spark, np.column_stack([t, t**2, np.sin(2 * t)]))
    model = gradient.network(rows, subspace.moments(rows)[()], (6, 1, 6), target=None, rounds=60)
    threshold = gradient.auto_encoder_threshold(rows, model)
    off = table(spark, [[0.0, 1.5, 0.0], [0.9, -1.0, -1.0]]).select(model.score(F.col("features")).alias("s")).collect()
    assert all(r.s > threshold for r in off)


def test_the_driver_gets_one_array_a_key_whatever_the_tasks(spark, monkeypatch):
    from skein.functions.sums import added

    rows = spark.range(90).repartition(12)
    got = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: got.append(collect(df)) or got[-1])
    found = added(rows, lambda batch: {0: np.array([len(batch), batch["id"].sum()]), 3: np.ones(1) * len(batch)})
    assert len(got[0]) == 2 and found[0].tolist() == [90, 4005] and found[3].tolist() == [90]
