from pathlib import Path

import duckdb
import pytest

from foliant.plans import registry

SMALL = "/root/testdata/sf0.001"

WHOLE = "json_property mask_secrets upper_median grapheme_lengths collapse_space scalar_functions set_operations prefix_theta_join".split()


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables_equal_sql(spark, name):
    db = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[f"{name}_all"](spark, SMALL)
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[f'{name}_all']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(got) >= registry.queries()[name](spark, SMALL).count()
