"""The corpus queries that have SQL give its rows."""

from pathlib import Path

import duckdb
import pytest

from foliant.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(shipped, name):
    with duckdb.connect() as db:
        for f in Path(FOLDER).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        want = db.execute(queries.oracle_sql()[name])
        columns, rows = [c[0] for c in want.description], want.fetchall()
    got = queries.queries()[name](shipped, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(rows, key=str)
