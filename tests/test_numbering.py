import datetime

import numpy as np
import pytest

from skein.sources import tables


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Users of 0 to 130 events, in places equal or null times; some of no user."""
    rng, rows = np.random.default_rng(8), []
    for user, n in ((0, 130), (1, 40), (2, 41), (3, 39), (4, 80), (None, 50)):
        for k in range(n):
            ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=int(rng.integers(0, 600)))
            rows.append((len(rows), None if user == 4 and k < 3 else ts, user, float(np.round(rng.exponential(50), 2))))
    folder = str(tmp_path_factory.mktemp("numbered"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").repartition(5).write.parquet(f"{folder}/events.parquet")
    return folder, rows


def test_places_gaps_and_totals(spark, events, monkeypatch):
    folder, rows = events
    want = []
    for user in range(5):
        own = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
        for k, (_, ts, _, value) in enumerate(own):
            before = own[k - 1][1] if k else None
            gap = (ts - before).total_seconds() if ts is not None and before is not None else 0.0
            want.append((user, value, gap, k + 1, len(own), round(sum(r[3] for r in own), 6)))
    for many in (tables.MANY, 60, 0):
        monkeypatch.setattr(tables, "MANY", many)
        got = [(r.user_id, r.value, r.gap, r.r, r.n, round(r.total, 6)) for r in tables.numbered_events(spark, folder).collect()]
        assert sorted(got) == sorted(want)


def test_cycles_are_the_same_hour_by_hour(spark, events, monkeypatch):
    made = []
    for many in (tables.MANY, 60):
        monkeypatch.setattr(tables, "MANY", many)
        rows = tables.labelled_cycles(spark, events[0], 40, ("value", "gap")).collect()
        made.append(sorted((r.cycle_id, r.sensor, r.samples, r.u, r.target, round(r.y, 9)) for r in rows))
    assert made[0] == made[1] and len(made[0]) == 2 * (4 + 1 + 2 + 2)


def test_users_of_few_events_are_moved_once(spark, data):
    """Numbered and put into cycles where they are after one exchange by user."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = tables.labelled_cycles(spark, data, 40, ("value", "gap"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert 1 <= len(moved) <= 2 and all("hashpartitioning(user_id" in line and "hour" not in line for line in moved)
