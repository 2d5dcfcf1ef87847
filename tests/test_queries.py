"""Every registered query gives the rows of its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from foliant.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as con:
        for f in Path(SMALL).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        yield con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, dict):
        return str(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")[:19] if hasattr(value, "hour") else value.isoformat()
    return str(float(value)) if isinstance(value, int) and not isinstance(value, bool) else f"{float(value):.6g}" if type(value).__name__ == "Decimal" else str(value)


def number(text):
    try:
        return f"{float(text):.5g}"
    except ValueError:
        return text


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_those_of_the_sql(spark, db, name):
    want = db.execute(registry.oracle_sql()[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    got = registry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    found = [tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted([number(plain(v)) for v in r] for r in found) == sorted([number(plain(v)) for v in r] for r in rows)
