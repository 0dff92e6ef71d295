import pytest

from skein.plans import catalogue
from tests.compare import same_rows

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, oracle, name):
    same_rows(QUERIES[name](spark, data), oracle, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_works_without_the_training_data_operators(spark):
    import subprocess
    import sys

    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['skein.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=e.ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout) == len(QUERIES)
