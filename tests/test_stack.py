import numpy as np
import pytest

from skein.operators import selector
from skein.operators.network import layers
from skein.operators.stack import EXTRACTORS, PRESETS, Stack

RNG = np.random.default_rng(4)


def cycles(spark, n=60, length=24):
    rows = []
    for k in range(n):
        c, y = k % 2, float(2 * (k % 2) + RNG.normal(0, 0.1))
        for sensor, gain in (("a", 3.0), ("b", 0.0)):
            x = RNG.normal(0, 1, length) + gain * c * (np.arange(length) > 11)
            rows.append((k, sensor, c, y, [float(v) for v in x], [0.1] * length))
    return spark.createDataFrame(rows, "cycle_id long, sensor string, target int, y double, samples array<double>, u array<double>")


def test_a_classifying_stack_learns_and_tells_where_features_come_from(spark):
    rows = cycles(spark)
    fitted = Stack(["piecewise"], "pearson", most=4, folds=5, sizes={"piecewise": 6}).fit(rows)
    truth = dict(rows.select("cycle_id", "target").distinct().collect())
    got = fitted.propagate(rows).collect()
    assert np.mean([r.prediction == truth[r.cycle_id] for r in got]) > 0.9
    assert all(r.min_pred <= r.prediction <= r.max_pred for r in got)
    assert fitted.provenance()[0][1] == "a" and len(fitted.losses) == 4 and fitted.loss == min(x for _, x in fitted.losses)


def test_uncertainty_of_a_regression_is_linear_in_that_of_the_samples(spark):
    rows = cycles(spark)
    fitted = Stack(["principal"], "pearson", "pls", most=3, folds=5, sizes={"principal": 3}).fit(rows)
    one = {r.cycle_id: r.u for r in fitted.propagate(rows).collect()}
    from pyspark.sql import functions as F

    two = {r.cycle_id: r.u for r in fitted.propagate(rows.withColumn("u", F.transform("u", lambda x: 2 * x))).collect()}
    assert all(two[k] == pytest.approx(2 * v) and v > 0 for k, v in one.items())


def test_presets_name_known_parts():
    assert len(PRESETS) == 27 and all(set(s.extractors) <= set(EXTRACTORS) for s in PRESETS.values())
    assert layers(10, 3, 2) == [10, 5, 3, 3]


@pytest.mark.parametrize("names", [("moments-pearson-lda", "wavelet-relief-lda", "piecewise-elimination-lda"), ("fourier-spearman-pls", "principal-pearson-pls")])
def test_selection_equals_each_stack_by_itself(spark, names):
    from dataclasses import replace

    from pyspark.sql import functions as F

    rows = cycles(spark, 48, 16)
    candidates = {n: replace(PRESETS[n], folds=4, most=6) for n in names}
    y = candidates[names[0]].y
    held = selector.dealt(rows, y, 3).persist()
    want = {}
    for n, stack in candidates.items():
        off = []
        for f in range(3):
            train, test = held.where(F.col("_outer") != f), held.where(F.col("_outer") == f)
            truth = dict(test.select("cycle_id", y).distinct().collect())
            off += [(r.prediction != truth[r.cycle_id]) if y == "target" else (r.prediction - truth[r.cycle_id]) ** 2 for r in stack.fit(train).transform(test).collect()]
        want[n] = 100 * np.mean(off) if y == "target" else np.sqrt(np.mean(off))
    found = selector.select_stack(rows, candidates, 3)
    assert dict(found.board) == pytest.approx(want) and [n for n, _ in found.board] == sorted(want, key=lambda n: (dict(found.board)[n], n))
    assert found.name == found.board[0][0] and found.transform(rows).count() == 48


@pytest.mark.parametrize("extractor", ["fourier", "moments", "time-frequency", "wavelet", "piecewise"])
def test_uncertain_features_meet_simulation(spark, extractor):
    rows = cycles(spark, 12, 24)
    made = EXTRACTORS[extractor](rows.where("sensor = 'a'"), *([2] if extractor in ("time-frequency", "moments") else [None] if extractor != "piecewise" else [4]))
    x = np.array(rows.where("sensor = 'a'").first().samples)[None]
    u = np.full((1, 24), 1e-4)
    draws = made.apply(x + RNG.normal(0, 1e-4, (20_000, 24)))
    got = np.sqrt(made.variance(x, u * u))[0]
    ok = np.isfinite(got) & (np.abs(draws).max(axis=0) < 1e6)
    assert ok.sum() >= len(made.names) - 2 and np.allclose(got[ok], draws.std(axis=0)[ok], rtol=0.05, atol=1e-9)


def test_a_non_linear_stack_carries_uncertainty_to_its_predictions(spark):
    from pyspark.sql import functions as F

    rows = cycles(spark, 40, 16)
    fitted = Stack(["fourier", "moments"], "pearson", "pls", most=4, folds=4, sizes={"fourier": 3, "moments": 2}).fit(rows)
    small = rows.withColumn("u", F.transform("u", lambda _: F.lit(1e-4)))
    want = {r.cycle_id: r.u for r in fitted.propagate(small).collect()}
    one = small.where("cycle_id = 7").collect()
    noisy = [(k, r.sensor, r.target, r.y, (np.array(r.samples) + RNG.normal(0, 1e-4, 16)).tolist(), r.u) for k in range(1500) for r in one]
    spread = np.std([r.prediction for r in fitted.transform(spark.createDataFrame(noisy, rows.schema)).collect()])
    assert want[7] == pytest.approx(spread, rel=0.25) and len(want) == 40
    classes = Stack(["moments"], "pearson", "lda", most=3, folds=4, sizes={"moments": 2}).fit(rows).propagate(rows).collect()
    assert all(r.min_pred <= r.prediction <= r.max_pred for r in classes)


def test_stacks_read_cycles_that_were_made_once(spark, data):
    """Each pass of a fit would number all events again otherwise."""
    from skein.plans import stacks

    rows = stacks.cycles(spark, data)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and rows.where("sensor = 'gap'").count() * 2 == rows.count() > 0


def test_cycles_and_their_targets_come_from_one_numbering_of_the_events(spark, data):
    from skein.functions.layout import pack
    from skein.sources.tables import event_cycles, event_targets, labelled_cycles

    rows = labelled_cycles(spark, data, 40, ("value", "gap"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "events" not in plan.split("Join")[0]
    want = pack(event_cycles(spark, data, 40, ("value", "gap"))).join(event_targets(spark, data, 40), "cycle_id")
    ours, theirs = (sorted(map(tuple, df.collect()), key=lambda r: r[:2]) for df in (rows, want))
    assert rows.columns == want.columns and [r[:5] for r in ours] == [r[:5] for r in theirs]
    assert np.allclose([r[5] for r in ours], [r[5] for r in theirs], rtol=1e-12)


def test_extractors_choose_what_sums_over_exploded_rows_choose(spark):
    from pyspark.sql import functions as F

    from skein.operators import spectrum, wavelet

    rows = cycles(spark, 30, 24).where("sensor = 'a'")
    long = rows.select("cycle_id", F.posexplode(wavelet.coefficients(F.col("samples"))).alias("i", "value")).withColumn("idx", F.col("i") + 1)
    for n in (None, 5):
        assert EXTRACTORS["wavelet"](rows, n).names == [f"w_{k}" for k in sorted(r.idx for r in wavelet.top(long, n).collect())]
        at = sorted(r.k for r in spectrum.top_bins(spectrum.bins(rows, keys=("cycle_id",)), n).collect())
        assert EXTRACTORS["fourier"](rows, n).names == [f"{s}_{k}" for s in ("amplitude", "phase") for k in at]


@pytest.mark.parametrize("extractor", ["wavelet", "fourier"])
def test_extractors_add_up_in_tasks(spark, extractor, monkeypatch):
    rows = cycles(spark, 30, 24).where("sensor = 'a'").repartition(6)
    explode = []
    monkeypatch.setattr("pyspark.sql.functions.posexplode", lambda *a: explode.append(a))
    assert EXTRACTORS[extractor](rows).names and not explode


def test_errors_are_counted_in_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from skein.operators import search, subspace

    rows = spark.createDataFrame([(k % 3, k % 2 if k else None, [float(k % 2) + 0.1 * (k % 7), float(k % 5)]) for k in range(40)], "fold int, target int, features array<double>").repartition(5)
    parts = subspace.moments(rows.where("target is not null"), ("fold", "target"))
    by_class = {(c,): search.total([m for k, m in parts.items() if k[1] == c]) for c in (0, 1)}
    model = subspace.lda(by_class)
    monkeypatch.setattr(F, "posexplode", None)
    got = search.errors(rows, {f: [([0, 1], model), ([1, 0], model)] for f in range(3)}, [0, 1])
    x = np.array([r.features for r in rows.collect()])
    truth = np.array([np.nan if r.target is None else r.target for r in rows.collect()])
    want = [100 * np.mean(model.distances(x[:, at]).argmin(axis=1) != truth) for at in ([0, 1], [1, 0])]
    assert got == pytest.approx(want) and got[0] > 0
