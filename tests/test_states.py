"""Status marks, outcomes, dismissals, table errors, snapshots, and lists of folders and failures."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import activity, store, sync, tables, vector
from foliant.sources import files, sheets

NOW = dt.datetime(2024, 5, 1, 12, 0)


def test_marks(spark):
    docs = spark.createDataFrame([(1, "pending", None, None, 3), (2, "pending", None, None, 2), (3, "done", None, None, 1)], "document_id long, status string, error string, next_retry_at timestamp, chunk_count int")
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "document_id long, text string")
    marks = spark.createDataFrame([(1, "failed", "timeout", None, False), (2, "waiting", "locked", NOW, True), (9, "failed", None, None, False)], "document_id long, status string, error string, next_retry_at timestamp, keep_chunks boolean")
    d, c = store.mark(docs, chunks, marks)
    assert d.columns == docs.columns
    assert {tuple(r) for r in d.collect()} == {(1, "failed", "timeout", None, 0), (2, "waiting", "locked", NOW, 2), (3, "done", None, None, 1)}
    assert sorted(r.text for r in c.collect()) == ["c", "d", "e"]
    same, kept = store.mark(docs, chunks, marks.limit(0))
    assert same.exceptAll(docs).count() == 0 and kept.count() == 5


def test_outcomes(spark):
    parsed = spark.createDataFrame([("a", None), ("b", "locked"), ("c", "timeout"), ("d", "unsupported"), ("e", "truncated"), ("f", "ValueError: x")], "path string, error string")
    got = {r.path: tuple(r)[1:] for r in sync.outcomes(parsed, F.lit(NOW)).collect()}
    assert got == {
        "a": ("done", None, None, True), "b": ("waiting", "locked", NOW + dt.timedelta(minutes=5), True), "c": ("failed", "timeout", None, False), "d": ("skipped", "unsupported", None, False),
        "e": ("done", "truncated", None, True), "f": ("failed", "ValueError: x", None, False),
    }


def test_dismissed_questions(spark):
    rows = [(f"x/{i}", "missing" if i < 40 else "same") for i in range(100)] + [(f"y/{i}", "missing" if i < 5 else "same") for i in range(10)]
    changes, folder = spark.createDataFrame(rows, "path string, change string"), F.element_at(F.split("path", "/"), 1)
    nothing = spark.createDataFrame([], "folder string, files long, at timestamp")
    first = {r.folder: r for r in sync.still_asked(changes, folder, nothing, F.lit(NOW)).collect()}
    assert first["x"].hold and not first["y"].hold and first["x"].n_missing == 40
    for hours, files_, hold in ((1, first["x"].files, False), (25, first["x"].files, True), (1, first["x"].files + 1, True)):
        dismissed = spark.createDataFrame([("x", files_, NOW - dt.timedelta(hours=hours))] * 2, "folder string, files long, at timestamp")
        got = sync.still_asked(changes, folder, dismissed, F.lit(NOW)).filter("folder = 'x'").collect()
        assert [r.hold for r in got] == [hold]


def test_lists(spark):
    docs = spark.createDataFrame(
        [("a", "a/=1.txt", "failed", "timeout", NOW), ("a", "a/2", "done", None, NOW - dt.timedelta(minutes=4)), ("b", "b/1", "waiting", "locked", NOW - dt.timedelta(minutes=6)), ("c", "c/1", "done", None, NOW), ("a", "=x", "failed", "odd", None)],
        "folder string, path string, status string, error string, updated_at timestamp",
    )
    assert {tuple(r) for r in activity.failed_files(docs, {"timeout": "took too long"}, "can't be read").collect()} == {("a/=1.txt", "took too long", "timeout"), ("'=x", "can't be read", "odd")}
    assert {tuple(r) for r in activity.folder_states(docs, F.lit(NOW)).collect()} == {("a", "problem", 3, 2, 2), ("b", "running", 1, 0, 0), ("c", "done", 1, 0, 1)}
    assert activity.counted_up_to(docs, 3) == (3, True) and activity.counted_up_to(docs, 5) == (5, False)


def test_parse_limits(spark):
    class Slow:
        left = 5

    with pytest.raises(files.ParseTimeout), files.time_limit(0.05):
        try:
            while True:
                time.sleep(0.01)
        except Exception:  # a parser's own handling doesn't take it
            pass
    with files.time_limit(0.05):
        pass
    time.sleep(0.1)
    rows = spark.createDataFrame([("a.txt", bytearray(b"text")), ("b.txt", None), ("c.zzz", bytearray(b"x"))], "path string, content binary")
    assert {r.path: r.error for r in files.parse(rows).collect()} == {"a.txt": None, "b.txt": "locked", "c.zzz": "unsupported"}
    budget = files.Budget(10)
    assert budget.take(6) and not budget.take(6)


@pytest.mark.parametrize(("error", "kind"), [(FileNotFoundError("x"), "missing"), (KeyError("range"), "moved"), (PermissionError("x"), "locked"), (ValueError("bad zip"), "unreadable")])
def test_table_errors(error, kind):
    def load():
        raise error

    with pytest.raises(tables.TableQueryError) as e:
        tables.loading("table 1", load)
    assert e.value.kind == kind


def test_table_errors_of_spark(spark):
    with pytest.raises(tables.TableQueryError) as e:
        tables.loading("t", lambda: spark.read.parquet("/nosuch/folder"))
    assert e.value.kind == "missing"
    with pytest.raises(tables.TableQueryError) as e:
        tables.loading("t", lambda: spark.range(1).select())
    assert e.value.kind == "no_columns"


def test_large_values_are_refused(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_VALUE_BYTES", 1000)
    t = spark.createDataFrame([("x", 1.0)], "a string, b double")
    assert tables.query(t, "SELECT repeat(a, 1000) AS r, b FROM t", timeout_s=60).rows == [["x" * 1000, "1"]]
    with pytest.raises(tables.TableQueryError, match="larger"):
        tables.query(t, "SELECT repeat(a, 1001) FROM t", timeout_s=60)


def test_snapshots(spark):
    df = spark.createDataFrame([(1, "m", [1.0, 2.0]), (2, "m", [1.0]), (3, "n", [1.0, 1.0])], "vec_id long, model string, embedding array<float>")
    s, loads, gate = vector.Snapshots(), [], threading.Event()

    def load():
        loads.append(1)
        return df

    a = s.get(load, 2, 1, "m")
    assert [r.vec_id for r in a.collect()] == [1] and s.get(load, 2, 1, "m") is a and len(loads) == 1

    def slow():
        gate.wait(30)
        return load()

    t = threading.Thread(target=lambda: s.get(slow, 2, 2, "m"))
    t.start()
    while not s.gate.locked():
        time.sleep(0.01)
    assert s.get(load, 2, 2, "m") is a  # stale, but there
    gate.set()
    t.join()
    assert s.get(load, 2, 2, "m") is not a and len(loads) == 2
    assert [r.vec_id for r in s.get(load, 1, 2, "m").collect()] == [2]


def test_table_summary():
    region = sheets.Region("k", "S", (1, 1, 3, 2), 1, ["名", "值"], [["a\nb", None], ["x" * 120, "2"]], "標")
    assert region.summary("f.xlsx").split("\n") == ["檔案：f.xlsx", "工作表：S（範圍 A1:B3，共 2 筆資料）", "表格標題：標", "欄位：名、值", "範例資料：", "名=a b；值=", f"名={'x' * 100}…；值=2", "（完整內容請使用 query_table 查詢）"]
