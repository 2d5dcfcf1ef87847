"""Parts meet suppliers by equal key prefixes, not by trying every pair."""

import io
from contextlib import redirect_stdout

import duckdb

from foliant.plans import registry


def _tables(spark, folder):
    brands = ["Brand#1", "BRAND#2", None]
    spark.createDataFrame([(k,) for k in (*range(0, 130), -1, -12, None, 7)], "s_suppkey long").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(k, brands[i % 3]) for i, k in enumerate((*range(0, 1300), -1, -123, -1231, None))], "p_partkey long, p_brand string").coalesce(1).write.parquet(f"{folder}/part.parquet")


def _sql(folder, sql):
    db = duckdb.connect()
    for t in ("supplier", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(db.execute(sql).fetchall())


def test_join_is_an_equality_of_prefixes(spark, tmp_path):
    _tables(spark, str(tmp_path))
    df = registry.queries()["prefix_theta_join"](spark, str(tmp_path))
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    keys = [line for line in out.getvalue().splitlines() if "Left keys" in line]
    assert len(keys) == 1 and "head" in keys[0] and "StartsWith" not in out.getvalue()
    assert sorted(map(tuple, df.collect())) == _sql(tmp_path, registry.oracle_sql()["prefix_theta_join"])


def test_pairs_with_other_last_digits_are_kept(spark, tmp_path):
    _tables(spark, str(tmp_path))
    got = sorted(map(tuple, registry.queries()["prefix_theta_join"](spark, str(tmp_path)).collect()))
    assert (1, 12) in got and (12, 123) in got and (-12, -1231) in got and got.count((7, 72)) == 2
    assert got == _sql(tmp_path, "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON starts_with(lower(p_brand) || p_partkey, lower(p_brand) || s_suppkey)")
