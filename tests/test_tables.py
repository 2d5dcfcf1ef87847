import pytest

from foliant.operators import tables


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("2025/1/5", "甲", "1,200", "25.6%", "001", ""), ("2025/1/6", "乙", "800", "10%", "002", None), ("2025/1/7", "甲", "-50", "5%", "003", " ")]
    return spark.createDataFrame(rows, "`日期` string, `客戶` string, `金額(元)` string, `毛利率` string, `編號` string, `備註` string")


def test_inference_and_description(sales):
    d = tables.describe(sales)
    assert [c[2] for c in d.columns] == ["date", "text", "number", "number", "text", "text"]
    assert d.columns[2][0] == "金額_元_" and d.row_count == 3 and d.samples[0][5] == "NULL"


def test_query(sales):
    t = tables.typed(sales)
    r = tables.query(t, 'SELECT "客戶", SUM("金額_元_") AS s FROM t GROUP BY 1 ORDER BY 2 DESC;', timeout_s=60)
    assert r.rows == [["甲", "1150"], ["乙", "800"]] and not r.truncated
    assert tables.query(t, "with x as (select * from t) select 1/0 as z from x", max_rows=2, timeout_s=60) == tables.QueryResult(["z"], [["NULL"], ["NULL"]], True)


@pytest.mark.parametrize(
    "sql",
    ["DELETE FROM t", "DROP TABLE t", "SELECT 1; SELECT 2", "ATTACH 'x'", "PRAGMA x", "SELECT load_extension('x')", "SELECT 'x", "INSERT INTO t VALUES (1)", "WITH a AS (SELECT 1) DELETE FROM t", " ", "SELECT reflect('java.lang.System', 'exit', 1)"],
)
def test_refused(sql):
    with pytest.raises(tables.TableQueryError):
        tables.guard(sql)


@pytest.mark.parametrize("sql", ["SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "SELECT * FROM t WHERE 1 IN (SELECT 1 FROM other)", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"])
def test_refused_plans(spark, sql):
    with pytest.raises(tables.TableQueryError):
        tables.check_plan(spark, tables.guard(sql))


def test_accepted():
    for sql in ("select 1;", "-- note\nSELECT 1", "/* x */ with a as (select 1) select * from a", "SELECT 'drop; table' AS \"delete\" FROM t"):
        assert tables.guard(sql)


def test_failures_name_columns(sales):
    with pytest.raises(tables.TableQueryError, match="編號"):
        tables.query(tables.typed(sales), "SELECT nothing FROM t", timeout_s=60)


def test_cache(spark, sales):
    now, loads = [0.0], []
    cache = tables.TableCache(2, 60, lambda: now[0])
    load = lambda: loads.append(1) or sales.limit(1)
    cache.get("a", 1, load)
    cache.get("a", 1, load)
    assert len(loads) == 1
    cache.get("a", 2, load)
    now[0] = 61
    cache.get("a", 2, load)
    assert len(loads) == 3
    cache.get("b", 1, load), cache.get("c", 1, load), cache.get("a", 2, load)
    assert len(loads) == 6


@pytest.fixture
def other(spark):
    spark.range(3).createOrReplaceGlobalTempView("other")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW other AS SELECT 'secret' AS s")
    yield "other"
    spark.catalog.dropTempView("other")
    spark.catalog.dropGlobalTempView("other")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 'other AS (' x, b.* FROM other b", "SELECT 1 /* , other AS ( */ FROM other", "WITH x AS (SELECT 'with other as (' y) SELECT * FROM x, other", "SELECT (SELECT max(s) FROM other)", "SELECT EXISTS (SELECT 1 FROM other)", "SELECT * FROM global_temp.other",
        "WITH a AS (SELECT * FROM other), other AS (SELECT 1) SELECT * FROM a", "WITH a AS (WITH other AS (SELECT 1) SELECT * FROM other) SELECT * FROM other", "SELECT * FROM t ORDER BY (SELECT count(*) FROM other)", "SELECT * FROM t JOIN LATERAL (SELECT * FROM other)",
        "SELECT * FROM t WHERE 1 NOT IN (SELECT 1 FROM other)", "SELECT sum(1) OVER (PARTITION BY (SELECT 1 FROM other)) FROM t", "SELECT java_method('java.lang.System', 'getenv', 'PATH')", "SELECT `reflect`('a', 'b')", "SELECT * FROM read_files('/etc')", "SELECT 1 UNION ALL SELECT id FROM other", "VALUES (1) UNION SELECT 2",
    ],
)
def test_guard_cant_be_widened_by_text(spark, other, sql):
    with pytest.raises(tables.TableQueryError):
        tables.check_plan(spark, tables._translate(tables.guard(sql)))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT version, set, add, show, use, describe FROM t", "SELECT 'FROM other' FROM t", "WITH a AS (SELECT * FROM t), b AS (SELECT * FROM a) SELECT * FROM b JOIN t", "SELECT * FROM (SELECT 1 AS x) s, LATERAL (SELECT x + 1)", "SELECT * FROM range(3)", "SELECT explode(array(1, 2))", "SELECT * FROM VALUES (1, 2) AS v(a, b)",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", "SELECT replace(x, 'a', 'b') FROM T", "SELECT * FROM t PIVOT (sum(a) FOR b IN (1, 2))", "SELECT count(*) FROM t WINDOW w AS (PARTITION BY a)",
    ],
)
def test_plain_queries_pass(spark, sql):
    tables.check_plan(spark, tables._translate(tables.guard(sql)))
