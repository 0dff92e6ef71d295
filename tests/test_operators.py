"""Independent recomputation and properties on small made-up cycles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.layout import pack, unpack
from skein.operators import classify, evaluate, multisensor, neighbours, novelty, piecewise, regress, resample, search, sections, segments, select, spectrum, subspace, wavelet

RNG = np.random.default_rng(0)


def packed(spark, x, u=None):
    rows = [(k, "s", [float(v) for v in row], [float(v) for v in (u[k] if u is not None else 0.01 * np.abs(row) + 0.001)]) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "cycle_id long, sensor string, samples array<double>, u array<double>")


def features(spark, x, y=None, z=None):
    rows = [(k, None if y is None else y[k], None if z is None else float(z[k]), [float(v) for v in row]) for k, row in enumerate(x)]
    kind = "string" if y is not None and isinstance(y[0], str) else "long"
    return spark.createDataFrame(rows, f"cycle_id long, target {kind}, y double, features array<double>")


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_pack_and_unpack_are_inverse(spark):
    rows = packed(spark, RNG.normal(size=(5, 7)))
    long = unpack(rows)
    back = {r.cycle_id: r.samples for r in pack(long.orderBy(F.rand(1))).collect()}
    assert back == {r.cycle_id: r.samples for r in rows.collect()}


def test_segment_bounds():
    assert segments.tumbling(11, 10) == [(k + 1, 2 * k + 1, min(11, 2 * k + 2)) for k in range(10)]
    assert segments.overlapping(10, 4)[:2] == [(1, 1, 3), (2, 3, 6)]
    assert segments.frequency_bands([(0.0, 0.25)], 1.0, 40) == [(1, 1, 11)]


def test_empty_segments_and_constants_give_null(spark):
    long = unpack(packed(spark, np.full((1, 11), 3.0)))
    bounds = segments.tumbling(11, 10)
    rows = {r.feature_idx: r.value for r in segments.features(segments.in_segments(long, bounds), segments.MOMENTS, bounds, ["cycle_id"]).collect()}
    assert len(rows) == 40 and rows[1] == 3.0 and rows[2] == 0.0 and rows[3] is None and rows[37] is None


def test_analytic_uncertainty_meets_simulation(spark):
    x = RNG.normal(5, 2, 12)
    u = np.full(12, 0.01)
    held = segments.in_segments(unpack(packed(spark, x[None], u[None])), segments.tumbling(12, 1))
    names = ["mean", "std", "var", "skew", "kurt", "rms", "slope", "max", "min", "crest"]
    got = segments.propagated(held, names, ["cycle_id"]).first().asDict()
    draws = x + RNG.normal(0, 0.01, (20000, 12))
    c = draws - draws.mean(axis=1, keepdims=True)
    m2, m3, m4 = ((c**p).mean(axis=1) for p in (2, 3, 4))
    t = np.arange(12) - 5.5
    rms = np.sqrt((draws**2).mean(axis=1))
    every = {"mean": draws.mean(axis=1), "std": draws.std(axis=1, ddof=1), "var": draws.var(axis=1, ddof=1), "skew": m3 / m2**1.5, "kurt": m4 / m2**2, "rms": rms, "slope": draws @ t / (t @ t), "max": draws.max(axis=1), "min": draws.min(axis=1), "crest": draws.max(axis=1) / rms}
    for n in names:
        assert got[n] == pytest.approx(every[n].std(), rel=0.05), n


def test_tone_has_one_line_and_parseval_holds(spark):
    t = np.arange(64)
    x = np.stack([np.cos(2 * np.pi * 5 * t / 64), RNG.normal(size=64)])
    rows = packed(spark, x)
    line = {r.k: r.value for r in spectrum.single_sided(rows).where("cycle_id = 0").collect()}
    assert line[5] == pytest.approx(1.0) and sum(v for k, v in line.items() if k != 5) < 1e-9
    z = spectrum.bins(rows, bins="onesided").where("cycle_id = 1").collect()
    power = sum((r.re**2 + r.im**2) * (1 if r.k in (0, 32) else 2) for r in z) / 64
    assert power == pytest.approx((x[1] ** 2).sum())


def test_all_fourier_coefficients_give_the_signal_back(spark):
    x = RNG.normal(size=(2, 16))
    x -= (x * (-1.0) ** np.arange(16)).mean(axis=1, keepdims=True) * (-1.0) ** np.arange(16)
    z = spectrum.bins(packed(spark, x))
    back = spectrum.reconstruct(spectrum.coefficients(z, z.select("k").distinct()), 16).orderBy("cycle_id", "t").collect()
    assert np.allclose([r.x for r in back], x.ravel())


@pytest.mark.parametrize(("n", "levels"), [(5, 0), (6, 1), (11, 1), (12, 2), (24, 3), (47, 3), (48, 4), (500, 7), (1000, 8)])
def test_wavelet_levels(n, levels):
    assert wavelet.levels(n) == levels


@pytest.mark.parametrize("n", [12, 41, 64])
def test_wavelet_is_inverted(spark, n):
    x = RNG.normal(size=(3, n))
    rows = packed(spark, x)
    back = rows.select(wavelet.reconstruct(wavelet.coefficients(F.col("samples")), n).alias("b")).collect()
    assert np.allclose([r.b for r in back], x)
    assert np.allclose(wavelet.LOW @ wavelet.LOW, 1) and abs(wavelet.LOW @ wavelet.HIGH) < 1e-12


def test_knots_are_found_and_the_lines_fit(spark):
    t = np.arange(1, 41)
    base = np.interp(t, [1, 11, 27, 40], [0, 20, -5, 9])
    rows = packed(spark, np.stack([base, 2 * base + 1]))
    sse = piecewise.error_matrix(piecewise.interval_errors(rows))
    error, splits = piecewise.best_splits(sse, 2)[-1]
    assert splits == [11, 27] and error < 1e-8
    assert piecewise.splits_for(sse, 6) == [11, 27]
    with pytest.raises(ValueError):
        piecewise.splits_for(sse, 3)
    noisy = packed(spark, base + RNG.normal(0, 0.5, (30, 40)))
    assert 2 <= len(piecewise.automatic_splits(piecewise.error_matrix(piecewise.interval_errors(noisy)))) <= 30
    bounds = piecewise.intervals(splits, 40)
    stats = segments.segment_statistics(segments.in_segments(unpack(rows), bounds), ["mean", "slope"], ["cycle_id"])
    lines = stats.join(segments.segments_table(spark, bounds), "seg")
    back = piecewise.reconstruct(lines, 40).where("cycle_id = 0").orderBy("t").collect()
    assert np.allclose([r.x for r in back], base)


def test_resampling(spark):
    assert [resample.factor(n) for n in (500, 501, 1300)] == [1, 2, 4]
    x = np.cos(2 * np.pi * np.arange(400) / 80)
    got = one(packed(spark, x[None]).select(resample.decimate(F.col("samples"), 4).alias("v")), "v")[0]
    assert len(got) == 100 and np.abs(np.array(got)[15:-15] - x[::4][15:-15]).max() < 0.01


def test_sections_follow_a_step(spark):
    x = np.where(np.arange(60) < 30, 0.0, 10.0) + RNG.normal(0, 0.01, (4, 60))
    assert any(28 <= a <= 32 for _, a, _ in sections.sections(unpack(packed(spark, x)), 60)[1:])


def test_selectors(spark):
    y = RNG.integers(0, 3, 60)
    x = np.stack([2.0 * y + 1, RNG.normal(size=60), np.ones(60), y + RNG.normal(0, 0.2, 60), 2.0 * y + 1], axis=1)
    rows = features(spark, x, y.tolist())
    long = select.long_features(rows)
    for scores in (select.pearson(long), select.spearman(long)):
        got = select.ranking(scores).orderBy("rank").collect()
        assert [r.feature_idx for r in got][:3] == [1, 5, 4] and got[0].score == pytest.approx(1.0) and got[-1].feature_idx == 3
    assert select.ranking(neighbours.relief(rows)).orderBy("rank").first().feature_idx in (1, 4, 5)
    with pytest.raises(ValueError):
        neighbours.relief(features(spark, x[:4], [0, 0, 0, 1]))


def test_neighbours_in_blocks_are_the_same(spark):
    x = RNG.normal(size=(40, 3))
    x[20:30] = x[:10]
    rows = features(spark, x, [i % 3 for i in range(40)])
    a, b = (sorted((r.cycle_id, r.other, round(r.distance, 9)) for r in neighbours.nearest(rows, rows, 3, block_rows=n).collect()) for n in (1000, 8))
    assert a == b
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.eye(40) * 1e9
    assert {(i, j) for i, j, _ in a} == {(i, int(j)) for i in range(40) for j in np.argsort(d[i], kind="stable")[:3]}
    c, e = (sorted((r.feature_idx, round(r.score, 9)) for r in neighbours.relief_with_priors(rows, block_rows=n).collect()) for n in (1000, 8))
    assert c == e and len(c) == 3


def test_neighbours_by_class_group_and_weight(spark):
    x = RNG.normal(size=(30, 2))
    rows = features(spark, x, [i % 2 for i in range(30)]).withColumn("g", F.when(F.col("cycle_id") < 25, F.col("cycle_id") % 3)).withColumn("weight", 1.0 + F.col("cycle_id") % 4)
    d = np.abs(x[:, None] - x[None]).sum(axis=2) * (1.0 + np.arange(30) % 4) + np.eye(30) * 1e9
    want = {(i, kind, int(j)) for i in range(25) for kind, odd in (("hit", 0), ("miss", 1)) for j in [j for j in np.argsort(d[i]) if (i + j) % 2 == odd and j < 25 and (i - j) % 3 == 0 and j != i][:2]}
    got = neighbours.nearest(rows, rows, 2, "cityblock", group="g", classes="own", block_rows=4).collect()
    assert {(r.cycle_id, r.kind, r.other) for r in got} == want and len(got) == len(want)
    assert neighbours.nearest(rows, rows.limit(0), 2).count() == 0 == neighbours.nearest(rows.limit(0), rows, 2).count()


def test_statistics_add_up_and_folds_subtract(spark):
    x = RNG.normal(size=(50, 4))
    rows = features(spark, x, (np.arange(50) % 3).tolist())
    parts, total = subspace.moments(rows, ("target",)), subspace.moments(rows)[()]
    for one, two in ((parts[(0,)] + parts[(1,)] + parts[(2,)], total), (total - parts[(0,)], parts[(1,)] + parts[(2,)])):
        assert one.n == two.n and np.allclose(one.mean, two.mean) and np.allclose(one.scatter, two.scatter)
    assert np.allclose(total.scatter / 49, np.cov(x.T))


def test_principal_components(spark):
    x = RNG.normal(size=(60, 5)) @ RNG.normal(size=(5, 5))
    rows = features(spark, x)
    p = subspace.pca(subspace.moments(rows)[()])
    assert p.explained.sum() == pytest.approx(1)
    back = one(rows.select(p.reconstruct(p.scores(F.col("features"))).alias("b")), "b")
    assert np.allclose(back, x)


def test_discriminant_is_affine_invariant_and_separates(spark):
    y = ["a"] * 40 + ["b"] * 40
    x = RNG.normal(size=(80, 3)) + np.where(np.arange(80)[:, None] < 40, 0, [4, 0, 0])
    turn = RNG.normal(size=(3, 3))
    predictions = []
    for data in (x, x @ turn + 7):
        rows = features(spark, np.hstack([data, np.ones((80, 1))]), y)
        model = subspace.lda(subspace.moments(rows, ("target",)))
        predictions.append(one(rows.orderBy("cycle_id").select(model.predict(F.col("features")).alias("p")), "p"))
    assert predictions[0] == predictions[1]
    assert np.mean([a == b for a, b in zip(predictions[0], y, strict=True)]) > 0.95


def test_all_components_of_pls_are_least_squares(spark):
    x = RNG.normal(size=(60, 3)) * [1, 10, 0.1]
    z = x @ [1.0, -2.0, 3.0] + 5 + RNG.normal(0, 0.1, 60)
    m = subspace.moments(features(spark, x, z=z), also=("y",))[()]
    model = regress.pls(m, 3)
    want = np.linalg.lstsq(np.hstack([np.ones((60, 1)), x]), z, rcond=None)[0]
    assert np.allclose([model.intercept, *model.beta], want)


def test_elimination_keeps_what_matters(spark):
    y = (np.arange(60) % 2).tolist()
    x = RNG.normal(size=(60, 4))
    x[:, 2] += 5 * np.array(y)
    x[:, 3] = 1.0
    rank = classify.recursive_elimination(subspace.moments(features(spark, x, y), ("target",)))
    assert rank[0] == 2 and rank[-1] == 3


def test_losses_and_roc(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 0.5), (2.0, 4.0, 0.5)], "prediction double, target double, u double")
    got = rows.agg(evaluate.classification_error().alias("e"), evaluate.rmse().alias("r"), evaluate.worst_case_rmse().alias("w")).first()
    assert (got.e, got.r, got.w) == (50.0, pytest.approx(2**0.5), pytest.approx(((0.25 + 6.25) / 2) ** 0.5))
    assert evaluate.spearman_loss(rows).first().loss == pytest.approx(0)
    scores = spark.createDataFrame([(float(k), k > 5) for k in range(10)], "score double, positive boolean")
    best = evaluate.auc(evaluate.roc(scores)).first()
    assert (best.auc, best.best_threshold) == (1.0, 6.0)


def test_novelty(spark):
    x = RNG.normal(size=(60, 3))
    far = np.full((2, 3), 9.0)
    train, new = features(spark, x), features(spark, far)
    scores, threshold = neighbours.distance_novelty(train, new)
    assert all(r.score > threshold for r in scores.collect())
    for model in (novelty.mixture(train, 2, 5), novelty.one_class(train)):
        own, other = (np.array(one(rows.select(model.score(F.col("features")).alias("s")), "s")) for rows in (train, new))
        assert other.max() < np.median(own)


def test_lanes_and_percent_cut(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "b", [3.0]), (2, "a", [1.0, 2.0])], "cycle_id long, sensor string, samples array<double>")
    got = multisensor.concatenated(rows, ["b", "a"]).collect()
    assert [(r.cycle_id, r.samples) for r in got] == [(1, [3.0, 1.0, 2.0])]


def test_bayesian_search_finds_the_valley():
    best, seen = search.bayesian(lambda n: (n - 17) ** 2, 1, 40, 14)
    assert abs(best - 17) <= 1 and len(seen) <= 14


def test_moments_keep_small_deviations_beside_large_means(spark):
    x = 1e8 + RNG.normal(size=(3000, 2))
    x[:, 1] += x[:, 0] - 1e8
    rows = features(spark, x, y=[k % 3 for k in range(len(x))]).repartition(7)
    parts = subspace.moments(rows, ("target",))
    total = parts[(0,)] + parts[(1,)] + parts[(2,)]
    want = np.cov(x.T)
    for m in (total, subspace.moments(rows)[()], (total - parts[(0,)]) + parts[(0,)]):
        assert np.allclose(m.scatter / (m.n - 1), want, rtol=1e-6) and np.allclose(m.mean, x.mean(axis=0), rtol=1e-15)
    assert np.allclose(subspace.pca(total, 2).explained, np.sort(np.linalg.eigvalsh(want))[::-1] / np.trace(want), rtol=1e-6)


def test_constant_features_leave_the_majority_class(spark):
    rows = features(spark, np.full((9, 2), 3.0), y=[0, 1, 1, 1, 1, 1, 2, 2, 0])
    model = subspace.lda(subspace.moments(rows, ("target",)))
    assert set(one(rows.select(model.predict(F.col("features")).alias("p")), "p")) == {1}


def test_the_gap_statistic_finds_planted_clusters(spark):
    x = np.concatenate([RNG.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (0, 6))]) + 1e6
    rows = features(spark, x).repartition(5)
    found = novelty.gap_statistic(rows, most=8, references=6, rounds=8)
    assert found.k == 3 and found.gaps.argmax() == 2
    d = ((x[:, None] - np.stack([x[k * 60 : k * 60 + 60].mean(axis=0) for k in range(3)])[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert found.dispersion[2] == pytest.approx(d, rel=1e-6)
    again = novelty.gap_statistic(rows.repartition(2), most=8, references=6, rounds=8)
    assert np.allclose(again.gaps, found.gaps)
    model = novelty.mixture(rows)
    assert len(model.weights) == 3 and np.allclose(np.sort(model.weights), 1 / 3, atol=0.02)
    assert novelty.gap_statistic(features(spark, x[:2]), most=8, references=3, rounds=2).k in (1, 2)


def test_regression_relief_ranks_what_the_target_follows(spark):
    x = RNG.normal(size=(150, 4))
    rows = features(spark, x, z=3 * x[:, 1] + 0.1 * x[:, 3]).repartition(3)
    got = {r.feature_idx: r.score for r in neighbours.relief_regression(rows, k=8, sigma=4.0).collect()}
    assert max(got, key=got.get) == 2
    d = np.abs(x[:, None] - x[None])
    y = 3 * x[:, 1] + 0.1 * x[:, 3]
    near = np.argsort(d.sum(axis=2) + 1e9 * np.eye(150), axis=1)[:, :8]
    w = np.exp(-((np.arange(1, 9) / 4.0) ** 2))
    w = w / w.sum()
    dy = np.abs(y[:, None] - y[near]) / np.ptp(y)
    df = np.stack([d[k, near[k]] for k in range(150)]) / np.ptp(x, axis=0)
    ny, nf, nb = (w * dy).sum(), (w[None, :, None] * df).sum(axis=(0, 1)), ((w * dy)[:, :, None] * df).sum(axis=(0, 1))
    assert np.allclose([got[k] for k in (1, 2, 3, 4)], nb / ny - (nf - nb) / (150 - ny))


@pytest.mark.parametrize("classes, metric", [("own", "cityblock"), ("each", "cityblock"), (None, "euclidean")])
def test_neighbours_measure_few_of_all_pairs(classes, metric, monkeypatch):
    """Bounds rule out most pairs, and what is left has the same k nearest, ties to the smaller id, as all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 12)), 1)
    x[300:330] = x[7]
    names = [str(k % 4) for k in range(len(x))]
    rows = pa.table({"cycle_id": np.arange(len(x)), "features": pa.array(list(x)), "_class": names})
    measured, plain = [], neighbours._distances

    def counted(q, r, m):
        out = plain(q, r, m)
        measured.append(out.size)
        return out

    monkeypatch.setattr(neighbours, "_distances", counted)
    got = neighbours._best(rows, rows, 3, metric, classes, False).to_pylist()
    kind_of = {"own": lambda i, j: "hit" if names[i] == names[j] else "miss", "each": lambda _, j: names[j], None: lambda *_: "near"}[classes]
    want = []
    for i in range(len(x)):
        d = plain(x[i][None], x, metric)
        held: dict[str, list] = {}
        for j in sorted(set(range(len(x))) - {i}, key=lambda j: (d[j], j)):
            held.setdefault(kind_of(i, j), []).append((i, j, d[j]))
        want += [(kind, *row) for kind, rows_ in held.items() for row in rows_[:3]]
    assert sorted((r["kind"], r["cycle_id"], r["other"], r["distance"]) for r in got) == sorted(want)
    assert sum(measured) < len(x) ** 2 / 4


@pytest.mark.parametrize("classes, metric", [("own", "cityblock"), ("each", "cityblock"), (None, "euclidean")])
def test_two_blocks_meet_once_for_the_rows_of_both(classes, metric, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(1500, 6)), 1)
    x[40:60] = x[1400]
    names = [None if k % 11 == 0 else str(k % 3) if k < 900 else str(k % 4) for k in range(len(x))]
    rows = pa.table({"cycle_id": np.arange(len(x)), "features": pa.array(list(x)), "_class": pa.array(names, pa.string())})
    left, right = rows.slice(0, 900), rows.slice(900)
    listed = lambda t: sorted(map(repr, t.to_pylist()))
    want = [neighbours._best(a, b, 3, metric, classes, False) for a, b in ((left, right), (right, left))]
    bounded, most = [], neighbours._Bounds.most
    monkeypatch.setattr(neighbours._Bounds, "most", lambda *a: bounded.append(most(*a)) or bounded[-1])
    monkeypatch.setattr(neighbours, "WAITING", 500)
    got = neighbours._best(left, right, 3, metric, classes, False, both=True)
    assert listed(got) == listed(pa.concat_tables(want)) and sum(b.size for b in bounded) == 900 * 600


def test_one_table_is_compared_in_unordered_pairs_of_blocks(spark):
    x = np.round(RNG.normal(size=(400, 4)), 1)
    rows = features(spark, x, y=[k % 3 for k in range(len(x))])
    found = neighbours.places(rows, rows, 2, "cityblock", classes="own", block_rows=64)
    want = set()
    for i in range(len(x)):
        d = neighbours._distances(x[i][None], x, "cityblock")
        for kind, own in (("hit", True), ("miss", False)):
            near = sorted((j for j in range(len(x)) if j != i and (j % 3 == i % 3) == own), key=lambda j: (d[j], j))[:2]
            want |= {(i, kind, j, k + 1) for k, j in enumerate(near)}
    got = [(r.cycle_id, r.kind, r.other, r.place) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
