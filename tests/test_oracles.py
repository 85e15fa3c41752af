"""Every query with a DuckDB statement gives the same rows."""

import pytest
from compare import duck, mismatch

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_duckdb(name, spark, sf, con):
    assert mismatch(entry.queries()[name](spark, sf), entry.oracle_sql()[name], con) is None


#: Statements whose whole result is one row.
ONE_ROW = {"abs_error_summary", "adjusted_rand", "vocab_overlap", "multilabel_scores", "null_profile", "distinct_counts", "keyword_in_text"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle_compares_something(name, sf, con):
    """A statement without rows, or whose rows are all the same, would check nothing."""
    rows = con.execute(entry.oracle_sql()[name]).fetchall()
    assert rows and (len(rows) == 1 and name in ONE_ROW or len(set(map(str, rows))) > 1), len(rows)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
