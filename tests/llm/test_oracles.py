"""The queries of this subpackage against their DuckDB oracles, as the driver holds them."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    rows = lambda records: sorted(tuple(repr(r[c]) for c in cols) for r in records)
    got = rows(r.asDict() for r in df.collect())
    assert got == rows(dict(zip(want.columns, r)) for r in want.fetchall()) and got
