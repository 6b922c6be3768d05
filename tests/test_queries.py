"""Every registered query: against its DuckDB text, or for rows and schema where it has none."""

import pytest

from scoutframe.plans import check
from scoutframe.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return check.duckdb_connection(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, folder, name):
    problem = check.compare(spark, con, folder, name)
    assert problem is None or problem == "empty", problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() > 0
