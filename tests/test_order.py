import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.operators import evaluate, order, select

RNG = np.random.default_rng(11)


@pytest.fixture
def tied():
    """Three groups, one of them null; a third of all rows share one value."""
    n = 3000
    v = np.where(RNG.random(n) < 0.33, 7.0, RNG.integers(0, 500, n).astype(float))
    return pd.DataFrame({"id": np.arange(n), "g": [("a", "b", None)[k % 3] for k in range(n)], "v": v, "y": RNG.normal(size=n).round(1), "_part": 1})


@pytest.mark.parametrize("hot", [order.HOT, 8])
def test_mid_ranks_match_pandas(spark, tied, monkeypatch, hot):
    monkeypatch.setattr(order, "HOT", hot)
    got = select.mid_ranks(spark.createDataFrame(tied.drop(columns="_part")), "v", "r", ("g",)).toPandas().sort_values("id")
    assert len(got) == len(tied) and got["r"].tolist() == tied.groupby("g", dropna=False)["v"].rank().tolist()


def test_ranks_put_nulls_first_and_keep_repeats(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (3, float("nan"))], "id int, v double")
    assert sorted((r.id, r.r) for r in select.mid_ranks(rows, "v", "r", ()).collect()) == [(1, 1.5), (1, 1.5), (2, 3.0), (3, 4.0)]
    assert select.mid_ranks(rows.limit(0), "v", "r", ()).count() == 0


def test_running_sums_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).cast("long").alias("n"))
    got = order.running(rows, ("k",), ("n",)).collect()
    assert len(got) == 1000 and all(r.n_before == 2 * r.k for r in got)


@pytest.mark.parametrize("hot", [order.HOT, 4])
def test_folds_match_the_ordered_deal(spark, tied, monkeypatch, hot):
    monkeypatch.setattr(order, "HOT", hot)
    rows = spark.createDataFrame(tied)
    got = evaluate.stratified_folds(rows, 7, "id", "g").toPandas().sort_values("id")
    dealt = tied.assign(h=tied["id"] * evaluate.FOLD_PRIME % evaluate.FOLD_MODULUS).sort_values(["h", "id"])
    dealt["fold"] = dealt.groupby("g", dropna=False).cumcount() % 7
    assert got["fold"].tolist() == dealt.sort_values("id")["fold"].tolist() and list(got.columns) == [*tied.columns, "fold"]
    groups = evaluate.group_folds(rows, "g").groupBy("g").agg(F.collect_set("fold").alias("f"), F.count("*").alias("n")).collect()
    assert {(r.g, *r.f, r.n) for r in groups} == {(None, 1, 1000), ("a", 2, 1000), ("b", 3, 1000)}


def test_rows_of_one_id_share_a_fold(spark):
    rows = spark.createDataFrame([(k // 3, "x") for k in range(30)], "cycle_id long, target string")
    got = evaluate.stratified_folds(rows, 5).groupBy("cycle_id").agg(F.count_distinct("fold").alias("f"), F.count("*").alias("n")).collect()
    assert all((r.f, r.n) == (1, 3) for r in got)


def test_curve_of_tied_scores(spark, tied):
    frame = pd.DataFrame({"score": tied["y"], "positive": RNG.random(len(tied)) < 0.4})
    best = evaluate.auc(evaluate.roc(spark.createDataFrame(frame))).first()
    ranks, up = frame["score"].rank(), frame["positive"].sum()
    assert best.auc == pytest.approx((ranks[frame["positive"]].sum() - up * (up + 1) / 2) / up / (len(frame) - up))


def test_rank_loss_of_all_rows_and_of_groups(spark, tied):
    rows = spark.createDataFrame(tied.drop(columns="_part"))
    assert evaluate.spearman_loss(rows, "v", "y").first().loss == pytest.approx(1 - abs(tied["v"].rank().corr(tied["y"].rank())))
    for r in evaluate.spearman_loss(rows, "v", "y", ("g",)).collect():
        part = tied[tied["g"].isna()] if r.g is None else tied[tied["g"] == r.g]
        assert r.loss == pytest.approx(1 - abs(part["v"].rank().corr(part["y"].rank())))


def packed_ties(spark, n=2000):
    """Rows of a tied feature, one with nulls, a constant one and one like the target, which is tied too; some rows without features."""
    y = RNG.integers(0, 40, n)
    rows = [(int(k), float(y[k]), None if k % 97 == 0 else [float(RNG.integers(0, 9)), None if k % 5 == 0 else float(RNG.normal()), 3.0, float(y[k] + RNG.normal())]) for k in range(n)]
    return spark.createDataFrame(rows, "cycle_id long, y double, features array<double>")


def test_rank_correlations_of_all_features_are_those_of_long_rows(spark):
    rows = packed_ties(spark)
    want = {r.feature_idx - 1: r.score for r in select.spearman(select.long_features(rows, keep=("cycle_id", "y")), "y").collect()}
    got = select.rank_correlations(rows, "y")
    assert got == pytest.approx(want | {2: 0.0}, rel=1e-9, abs=1e-12) and got[3] > 0.9
    assert select.rank_correlations(rows.limit(0), "y") == {}


def test_stacks_of_one_table_rank_its_rows_once(spark, monkeypatch):
    from skein.operators.stack import Prepared

    calls = []
    running = order.running
    monkeypatch.setattr(order, "running", lambda *a: calls.append(a) or running(*a))
    table = Prepared(packed_ties(spark, 300), "y", {})
    assert table.by_rank_correlation([0, 1, 2])[-1] == 2 and table.by_rank_correlation([2, 3]) == [3, 2]
    assert len(calls) == 2
