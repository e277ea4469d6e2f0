"""Every query with a SQL counterpart gives DuckDB's rows."""

import pytest
from oracle import duck, rows_of

from loomgraph import queries as engine

SF = "/root/testdata/sf0.001"
#: Queries without a counterpart: that they run; test_route, test_stored and test_reach compare them with plain results.
FREE = sorted(set(engine.QUERIES) - set(engine.ORACLES))


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_matches_duckdb(spark, name):
    df = engine.QUERIES[name](spark, SF)
    columns, expected = duck(SF, engine.ORACLES[name])
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", FREE)
def test_runs(spark, name):
    df = engine.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and df.columns
