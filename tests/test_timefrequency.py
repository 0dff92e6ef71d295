import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import segments, timefrequency
from skein.operators.timefrequency import TimeFrequency

RNG = np.random.default_rng(8)


def packed(spark, x, u):
    rows = [(k, "s", None if v is None else [float(a) for a in v], [float(a) for a in e]) for k, (v, e) in enumerate(zip(x, u, strict=True))]
    return spark.createDataFrame(rows, "cycle_id long, sensor string, samples array<double>, u array<double>")


def test_a_tone_is_the_maximum_of_its_band():
    t = np.arange(60)
    x = np.where(t < 30, np.cos(2 * np.pi * 6 * t / 30), np.cos(2 * np.pi * 9 * t / 30))[None] + 5
    tf = TimeFrequency(2, 4)
    got = dict(zip(tf.names(60), tf.matrix(x)[0], strict=True))
    bands = tf.bands(30)
    for part, k in ((1, 6), (2, 9)):
        j = next(j for j, a, b in bands if a <= k + 1 <= b)
        assert got[f"max_t{part}_f{j}"] == pytest.approx(1.0) and got[f"argmax_t{part}_f{j}"] == k + 2 - bands[j - 1][1]
    assert got["rms_t1"] == pytest.approx(np.sqrt(25.5)) and got["min_t1_f1"] == 0


@pytest.mark.parametrize("tf", [TimeFrequency(3, 3), TimeFrequency(3, 4, scope="cycle"), TimeFrequency(rate=10.0, time=[(1, 17), (10, 33)], hertz=[(0.5, 3.0), (2.0, 5.0)])])
def test_variances_follow_from_differences(tf):
    x, v = RNG.normal(3, 2, (2, 33)), RNG.uniform(1e-8, 1e-6, (2, 33))
    step = 1e-6
    slopes = np.stack([(tf.matrix(x + step * e) - tf.matrix(x - step * e)) / (2 * step) for e in np.eye(33)], axis=2)
    assert np.allclose(np.sqrt(tf.variances(x, v, chunk=1)), np.sqrt((slopes**2 * v[:, None]).sum(axis=2)), rtol=1e-3, atol=1e-10)


def test_columns_of_cycles_of_any_length(spark):
    x = [RNG.normal(size=40), None, RNG.normal(size=27), np.zeros(0), np.full(40, 2.0)]
    rows = packed(spark, x, [np.full(0 if v is None else len(v), 0.1) for v in x])
    tf = TimeFrequency(3, 3)
    got = {r.cycle_id: r for r in rows.select("cycle_id", tf.features(F.col("samples")).alias("f"), tf.uncertainty(F.col("samples"), F.col("u")).alias("e"), tf.uncertainty(F.col("samples"), F.transform("u", lambda v: v * v), True).alias("v")).collect()}
    assert got[1].f is None and got[1].e is None
    for k in (0, 2):
        assert np.allclose(got[k].f, tf.matrix(np.array(x[k])[None])[0]) and np.allclose(got[k].e, got[k].v)
    names = tf.names(40)
    flat = dict(zip(names, zip(got[4].f, got[4].e, strict=True), strict=True))
    assert flat["rms_t1"][0] == pytest.approx(2.0) and flat["rms_t1"][1] == pytest.approx(0.1 / np.sqrt(14)) and flat["skew_t1"] == (None, None)
    assert flat["max_t1_f2"][1] is None


def test_simulation_is_the_same_over_any_blocks_and_meets_numpy(spark):
    x, u = RNG.normal(5, 1, (3, 20)), RNG.uniform(0.2, 0.9, (3, 20))
    rows, bounds = packed(spark, x, u), segments.tumbling(20, 2)
    one, eight = ({(r.cycle_id, r.seg, r.statistic): (r.mean, r.u, r.runs) for r in timefrequency.simulated(rows, bounds, runs=40_000, unit=1000, blocks=b, seed=3).collect()} for b in (1, 8))
    assert one.keys() == eight.keys() and len(one) == 3 * 2 * 4
    for k, v in one.items():
        assert eight[k] == pytest.approx(v, rel=1e-9) and v[2] == 40_000
    for c in range(3):
        draws = x[c] + RNG.normal(size=(200_000, 20)) * u[c]
        for k, a, b in bounds:
            part = draws[:, a - 1 : b]
            want = {"argmax": part.argmax(axis=1) + 1, "max": part.max(axis=1), "min": part.min(axis=1), "crest": part.max(axis=1) / np.sqrt((part**2).mean(axis=1))}
            for s, w in want.items():
                mean, spread, _ = one[c, k, s]
                assert spread == pytest.approx(w.std(), rel=0.02) and mean == pytest.approx(w.mean(), rel=0.02)


def test_simulation_of_a_last_short_unit_and_of_no_noise(spark):
    x = RNG.normal(5, 1, (1, 10))
    still = timefrequency.simulated(packed(spark, x, np.zeros((1, 10))), segments.tumbling(10, 1), runs=2500, unit=1000).collect()
    assert {r.runs for r in still} == {2500} and all(r.u == 0 for r in still)
    assert next(r.mean for r in still if r.statistic == "max") == x.max()


def test_extremes_are_those_of_all_statistics():
    rng = np.random.default_rng(3)
    places = [segments.NINE.index(n) for n in timefrequency.ORDER]
    for x in (rng.normal(size=(200, 13)), np.zeros((3, 4)), np.array([[1.0, np.nan, 3.0]]), np.zeros((2, 0)), np.round(rng.normal(size=(200, 5)))):
        assert np.array_equal(timefrequency.extremes(x), timefrequency.nine(x)[:, places], equal_nan=True)
