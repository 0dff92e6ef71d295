"""Queries on whole stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.storage import stored
from skein.operators import network, optimiser, search, selector
from skein.operators.stack import BASE, PRESETS
from skein.sources.tables import embedding_features, labelled_cycles

T = 40


def cycles(spark, d):
    """Packed cycles of both sensors with their targets, made once: fitting a stack reads them many times."""
    return stored(labelled_cycles(spark, d, T, ("value", "gap")), "cycles")


def q61_stack(spark, d):
    """A preset fitted and applied: predicted class of each cycle."""
    rows = cycles(spark, d)
    return PRESETS["piecewise-pearson-lda"].fit(rows).transform(rows)


def q62_uncertain_stack(spark, d):
    """A regression preset with the uncertainty of each prediction."""
    rows = cycles(spark, d)
    return PRESETS["principal-pearson-pls"].fit(rows).propagate(rows)


def q63_preset_leaderboard(spark, d):
    """Cross-validated losses on shared folds of the presets that differ in what they extract: each extractor alone and all together."""
    rows = cycles(spark, d)
    names = [f"{e}-pearson-lda" for e in (*BASE, "all")]
    board = search.leaderboard({n: (lambda n=n: PRESETS[n].fit(rows).loss) for n in names})
    return spark.createDataFrame([(k + 1, n, x) for k, (n, x) in enumerate(board)], "place int, preset string, loss double")


def q64_stack_provenance(spark, d):
    return spark.createDataFrame(PRESETS["wavelet-pearson-lda"].fit(cycles(spark, d)).provenance(), "place int, sensor string, extractor string, name string").withColumn("stack", F.lit("wavelet-pearson-lda"))


def q67_perceptron(spark, d):
    rows = embedding_features(spark, d)
    return network.predict(*network.fit(rows), rows)


FOLDS = 2


def _boards(spark, d):
    rows = cycles(spark, d)
    return [(kind, selector.board(rows, {n: s for n, s in PRESETS.items() if s.y == kind}, FOLDS)) for kind in ("target", "y")]


def q72_selector_board(spark, d):
    """All presets, cross-validated as wholes on shared folds: percent of wrong classes, and RMSE of the regressions."""
    made = [(kind, k + 1, n, x) for kind, board in _boards(spark, d) for k, (n, x) in enumerate(board)]
    return spark.createDataFrame(made, "predicts string, place int, preset string, loss double")


def q73_selected_stack(spark, d):
    """Predictions of the best classifying preset of three extractors, chosen on shared folds and refitted on all cycles."""
    rows = cycles(spark, d)
    found = selector.select_stack(rows, {f"{e}-pearson-lda": PRESETS[f"{e}-pearson-lda"] for e in ("piecewise", "fourier", "moments")}, FOLDS)
    return found.transform(rows).withColumn("preset", F.lit(found.name))


def q74_uncertain_nonlinear_stack(spark, d):
    """A regression on amplitudes and phases, the uncertainty of each prediction carried through their derivatives."""
    rows = cycles(spark, d)
    return PRESETS["fourier-pearson-pls"].fit(rows).propagate(rows)


def q89_optimised_pipeline(spark, d):
    """What a Bayesian search over extractors by sensor, ranker, learner and number of features tried, in its order, and which it chose."""
    found = optimiser.optimise(cycles(spark, d), ("piecewise", "fourier", "moments"), ("pearson", "elimination"), rounds=4, batch=4, folds=3)
    made = [(k + 1, ", ".join(names[:-2]), *names[-2:], n, x, (names, n) == found.point) for k, ((names, n), x) in enumerate(found.history.items())]
    return spark.createDataFrame(made, "place int, extractors string, ranker string, learner string, features int, loss double, chosen boolean")


NAMED = [q61_stack, q62_uncertain_stack, q63_preset_leaderboard, q64_stack_provenance, q67_perceptron, q72_selector_board, q73_selected_stack, q74_uncertain_nonlinear_stack, q89_optimised_pipeline]


def oracle() -> dict[str, str]:
    return {}
