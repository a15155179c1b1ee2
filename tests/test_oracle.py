"""Every registered query vs its DuckDB twin at sf0.01 (columns, types, values)."""

import pytest

from tests.conftest import SF01
from tests.oracle_compare import compare, duck
from wordlake.plans import QUERIES

WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in QUERIES.items() if not q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_duckdb(spark, con, name):
    r = compare(spark, name, SF01, con)
    assert r["match"], r
    assert r["types_match"], r


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    df = QUERIES[name].build(spark, SF01)
    assert df.count() >= 0
