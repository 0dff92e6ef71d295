import numpy as np
import pytest

from skein.operators import resample
from skein.operators.stack import fit_identity, fit_piecewise, fit_principal
from skein.sources.tables import daily_cycles

RNG = np.random.default_rng(8)
LENGTH = 1300


def packed(spark, x):
    rows = [(k, [float(v) for v in row], [0.5] * len(row)) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "cycle_id long, samples array<double>, u array<double>")


def column(df, name):
    return np.array([r[0] for r in df.orderBy("cycle_id").select(name).collect()])


@pytest.mark.parametrize("p", [1, 2, 3, 7])
def test_phases_equal_the_convolution_of_stuffed_zeros(p):
    x = RNG.normal(size=(3, 31))
    stuffed = np.zeros((3, 31 * p))
    stuffed[:, ::p] = x
    assert np.allclose(resample.interpolated(x, p, 31 * p - 1), resample.filtered(stuffed, p * resample.low_pass(p))[:, :-1])
    assert np.allclose(resample.interpolated(x * x, p, 31 * p, True), resample.filtered(stuffed**2, (p * resample.low_pass(p)) ** 2))


def test_grid_takes_smooth_cycles_down_and_up_again():
    grid = resample.Grid.of(LENGTH)
    assert (grid.q, grid.size, grid.samples(1), grid.samples(325)) == (4, 325, (1, 4), (1297, 1300))
    assert resample.Grid.of(500) == resample.Grid(500, 1)
    t = np.arange(LENGTH)
    x = np.stack([np.sin(t / 60), np.cos(t / 45) * 3])
    back = grid.up(grid.down(x))
    assert back.shape == x.shape and np.abs(back - x)[:, 100:-100].max() < 0.02
    odd = resample.Grid(1301, 4)
    assert odd.down(np.zeros((1, 1301))).shape == (1, odd.size) and odd.up(np.zeros((1, odd.size))).shape == (1, 1301)
    assert odd.samples(odd.size) == (1301, 1301)


def test_variances_of_white_noise_follow_the_taps():
    grid = resample.Grid(LENGTH, 4)
    x = RNG.normal(0, 2, (4000, LENGTH))
    down, up = grid.down(x), grid.up(RNG.normal(0, 2, (4000, grid.size)))
    assert np.allclose(down.var(axis=0).mean(), grid.down_variance(np.full((1, LENGTH), 4.0)).mean(), rtol=0.02)
    assert np.allclose(up.var(axis=0).mean(), grid.up_variance(np.full((1, grid.size), 4.0)).mean(), rtol=0.02)


def test_breakpoints_and_lines_of_long_cycles(spark):
    t = np.arange(LENGTH)
    lines = np.where(t < 400, 0.01 * t, np.where(t < 900, 4 - 0.02 * (t - 400), -6 + 0.03 * (t - 900)))
    rows = packed(spark, np.stack([lines, 2 * lines, lines + RNG.normal(0, 0.01, LENGTH)]))
    e = fit_piecewise(rows, 6)
    got = column(rows.select("cycle_id", e.features(rows.samples).alias("f")), "f")
    assert got.shape == (3, 6) and np.allclose(got[0, [1, 3, 5]], [0.04, -0.08, 0.12], atol=0.01) and np.allclose(got[1], 2 * got[0], atol=0.02)
    back = column(rows.select("cycle_id", e.reconstruct(e.features(rows.samples)).alias("b")), "b")
    assert back.shape == (3, LENGTH) and np.abs(back[0] - lines)[60:-60].max() < 0.3
    u = column(rows.select("cycle_id", e.uncertainty(rows.samples, rows.u).alias("u")), "u")
    grid = resample.Grid.of(LENGTH)
    assert np.all(u > 0) and u[0, 0] < np.sqrt(grid.down_variance(np.full((1, LENGTH), 0.25))).max()


def test_components_of_long_cycles_all_a_tenth_and_to_the_elbow(spark):
    t = np.arange(LENGTH)
    x = RNG.normal(size=(40, 2)) * [5, 2] @ np.stack([np.sin(t / 50), np.cos(t / 70)]) + RNG.normal(0, 1e-3, (40, LENGTH))
    rows = packed(spark, x)
    assert len(fit_principal(rows, None).names) == 325 and len(fit_principal(rows, "percent").names) == 32
    e = fit_principal(rows, 2)
    assert 1 <= len(fit_principal(rows, "elbow").names) <= 3
    back = column(rows.select("cycle_id", e.reconstruct(e.features(rows.samples)).alias("b")), "b")
    assert np.abs(back - x)[:, 100:-100].max() < 0.1


def test_identity_and_extractors_without_a_way_back(spark):
    rows = packed(spark, RNG.normal(size=(2, 5)))
    e = fit_identity(rows)
    assert np.array_equal(column(rows.select("cycle_id", e.features(rows.samples).alias("f")), "f"), column(rows, "samples"))
    assert np.allclose(column(rows.select("cycle_id", e.uncertainty(rows.samples, rows.u).alias("u")), "u"), 0.5)
    from skein.operators.stack import fit_wavelet

    with pytest.raises(ValueError):
        fit_wavelet(rows, 2).reconstruct(rows.samples)


def test_daily_cycles_of_rows_with_nulls_and_of_none(spark, tmp_path):
    kind = "l_suppkey long, l_shipdate timestamp, l_quantity double"
    from datetime import datetime as at

    some = [(1, at(2000, 1, 1), 2.0), (1, at(2000, 1, 1, 9), 3.0), (1, at(2000, 1, 4), None), (2, at(2000, 1, 3), 7.0), (None, at(1999, 1, 1), 1.0), (2, None, 1.0)]
    spark.createDataFrame(some, kind).write.parquet(f"{tmp_path}/a/lineitem.parquet")
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/b/lineitem.parquet")
    assert {r.cycle_id: r.samples for r in daily_cycles(spark, f"{tmp_path}/a").collect()} == {1: [5.0, 0.0, 0.0, 0.0], 2: [0.0, 0.0, 7.0, 0.0]}
    assert daily_cycles(spark, f"{tmp_path}/b").collect() == []


def test_long_cycles_meet_in_bounded_pieces(spark, monkeypatch):
    """A vectorised function takes at most PIECE numbers at a time, Arrow batches of long arrays hold as many, and a task adds up one triangle of errors."""
    import pandas as pd

    from skein.functions import layout
    from skein.operators import piecewise

    monkeypatch.setattr(layout, "PIECE", 1000)
    column = pd.Series([np.zeros(300), None, *[np.ones(300)] * 9, np.zeros(5)])
    found = layout._by_length(column)
    assert sorted(k for at in found for k in at) == [0, *range(2, 12)] and max(300 * len(at) for at in found if at != [11]) <= 1000
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name, "10000")
    try:
        rows = layout.short_batches(spark.range(40).selectExpr("id cycle_id", "transform(sequence(1, 20), x -> cast(x * (id + 1) % 7 as double)) samples"), 200)
        assert int(spark.conf.get(name)) == 5
        one = rows.repartition(2)
        errors = piecewise.interval_errors(one)
        whole = {(r.i, r.j): r.sse for r in errors.collect()}
        assert len(whole) == 190
        x = np.array([r.samples for r in one.orderBy("cycle_id").collect()])
        t = np.arange(3, 9)
        line = np.polynomial.polynomial.polyfit(t, x[:, 3:9].T, 1)
        assert abs(whole[4, 9] - ((x[:, 3:9] - (line[0][:, None] + line[1][:, None] * t)) ** 2).sum()) < 1e-8
    finally:
        spark.conf.set(name, held)
