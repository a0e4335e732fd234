"""Every registered query against its DuckDB oracle, or for rows where there is none."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), con, ORACLES[name]) == ""


# Streams close windows only behind the watermark, every other query must give rows.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).limit(1).collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
