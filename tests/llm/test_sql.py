"""Queries that SQL can express, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from strataweave.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, str(DATA)), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
