import pytest

from tests.compare import spark_rows, sql_rows
from variorum import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    got, columns = spark_rows(queries.QUERIES[name](spark, DATA))
    want, named = sql_rows(queries.SQL[name], DATA)
    assert columns == named
    assert got == want


def test_queries_without_sql_are_tested_elsewhere():
    """test_folds, test_stitched and test_verifier compare each with its rules, and see that it has rows."""
    with open(__file__.replace("test_queries", "test_folds")) as f:
        told = f.read()
    assert [name for name in set(queries.QUERIES) - set(queries.SQL) if f'"{name}"' not in told] == []


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
