import math

import numpy as np

from skein.operators import optimiser
from tests.test_stack import cycles

SPACE = optimiser.Space((("a", "b", "c", "d"), ("a", "b", "c", "d"), ("p", "q", "r"), ("x", "y")), 200)
BEST = (("c", "b", "q", "y"), 17)


def planted(points):
    return [sum(w * (a != b) for w, a, b in zip((3, 2, 1, 1), names, BEST[0], strict=True)) + abs(math.log(n / BEST[1])) for names, n in points]


def test_it_beats_random_search_of_the_same_budget():
    ours, random = [], []
    for seed in range(8):
        ours.append(min(optimiser.minimise(SPACE, planted, 12, 4, seed).values()))
        rng = np.random.default_rng(seed)
        random.append(min(planted([SPACE.drawn(rng) for _ in range(48)])))
    assert np.mean(ours) < 0.5 * np.mean(random) and max(ours) <= max(random)


def test_searches_are_seeded_go_on_and_end_with_their_space():
    one = optimiser.minimise(SPACE, planted, 4, 3, 5)
    assert one == optimiser.minimise(SPACE, planted, 4, 3, 5) and len(one) == 12
    asked = []

    def counted(points):
        asked.extend(points)
        return planted(points)

    more = optimiser.minimise(SPACE, counted, 2, 3, 5, seen=one)
    assert list(more)[:12] == list(one) and len(asked) == 6 and not set(asked) & set(one)
    small = optimiser.Space((("a", "b"), ("p",)), 2)
    assert len(optimiser.minimise(small, lambda points: [0.0 for _ in points], 9, 3)) == 4
    assert all(1 <= SPACE.near(p, np.random.default_rng(k))[1] <= 200 for k, p in enumerate(one))


def test_a_pipeline_is_chosen_and_refitted(spark):
    rows = cycles(spark)
    found = optimiser.optimise(rows, ("piecewise", "moments"), ("pearson", "elimination"), most=6, rounds=2, batch=3, folds=3)
    assert len(found.history) == 6 and found.history[found.point] == min(found.history.values()) == found.fitted.loss
    truth = dict(rows.select("cycle_id", "target").distinct().collect())
    got = found.transform(rows).collect()
    assert len(got) == len(truth) and np.mean([r.prediction == truth[r.cycle_id] for r in got]) > 0.9
    assert [s for s, *_ in found.fitted.made] == ["a", "b"]


def test_losses_are_those_of_models_fitted_on_the_other_folds(spark):
    rows = cycles(spark)
    made = optimiser.Pipelines(rows, ("moments",), 3)
    point = (("moments", "moments", "pearson", "lda"), 3)
    wrong = n = 0
    for f, other in made.others.items():
        at, model = made.model(*point, other, f)
        for r in made.table.rows.where(f"fold = {f}").collect():
            x = np.array(r.features)[None][:, at]
            wrong += model.classes[int(model.distances(x).argmin())] != r.target
            n += 1
    assert n == 60 and abs(made.losses([point])[0] - 100 * wrong / n) < 1e-9
