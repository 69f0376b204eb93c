"""Every query against its DuckDB oracle."""

import duckdb
import pytest

from tidemark.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{sf_dir}/events.parquet'")
    return con


def rows(cols, records):
    return sorted(tuple(repr(r[c]) for c in cols) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    got = [r.asDict() for r in df.collect()]
    expected = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert rows(cols, got) == rows(cols, expected)
    if name != "point_lookup":
        assert got
