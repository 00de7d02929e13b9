"""Every named query against DuckDB's answer, on the smallest tables."""

import pytest
from compare import connect, difference

from corpusaudit.checks import load_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, duck, name):
    query = QUERIES[name]
    assert difference(query.run(spark, SF_DIR), duck, query.sql) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    first = QUERIES[name].run(spark, SF_DIR)
    assert first.count() > 0
    assert len(set(first.columns)) == len(first.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
