import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import select
from skein.plans import catalogue
from tests.compare import same_rows

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def written(folder, counts, again=1):
    """Events of users with ``counts`` events each, every event ``again`` times at its time, and a view of them."""
    rng, con = np.random.default_rng(3), duckdb.connect()
    con.execute("set TimeZone='UTC'")
    n = sum(counts)
    x = np.round(rng.exponential(50, n), 2)
    con.execute("create table made (event_id bigint, ts timestamp, user_id bigint, value double)")
    users = np.repeat(np.arange(len(counts)), counts)
    con.executemany("insert into made values (?, timestamp '2024-01-01' + to_seconds(?), ?, ?)", [[k * n + i, i * 97, int(users[i]), float(x[i])] for k in range(again) for i in range(n)])
    con.execute(f"copy made to '{folder}/events.parquet' (format parquet)")
    con.execute("create view events as select * from made")
    return con


@pytest.mark.parametrize("name", ["q00_flagship_ranking", "q54_provenance"])
def test_a_user_without_events_outside_a_cycle(spark, tmp_path, name):
    con = written(tmp_path, [70, 40, 93, 88, 120])
    same_rows(QUERIES[name](spark, str(tmp_path)), con, SQL[name])


def test_constant_features(spark, tmp_path):
    con = written(tmp_path, [8, 9, 12, 7], again=60)
    same_rows(QUERIES["q54_provenance"](spark, str(tmp_path)), con, SQL["q54_provenance"])


def test_correlation_is_of_rows_with_both_sides(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 1.0), (1, 4.0, 7.0), (1, None, 90.0), (1, 50.0, None), (2, 3.0, 1.0), (2, 3.0, 2.0), (3, None, 1.0)]
    long = spark.createDataFrame(rows, "feature_idx int, v double, target double")
    want = abs(np.corrcoef([1, 2, 4], [2, 1, 7])[0, 1])
    assert dict(map(tuple, select.pearson(long).collect())) == {1: pytest.approx(want), 2: 0.0, 3: 0.0}
    got = dict(map(tuple, select.pearson(long, undefined=float("nan")).where(~F.isnan("score")).collect()))
    assert got == {1: pytest.approx(want), 3: 0.0}
