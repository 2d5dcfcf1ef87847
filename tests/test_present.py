import pytest

from foliant.operators import present, tables
from foliant.operators.chunking import Location
from foliant.operators.service import Service


def test_locations():
    assert present.location_text(Location()) == ""
    assert present.location_text(Location(sheet="S", cell_range="A1:B2")) == "工作表「S」 · A1:B2"
    assert present.location_text(Location(page=3, heading_path=("A", "B"), title="B", embedded_path=("x.xlsx",))) == "內嵌：x.xlsx › 第 3 頁 · A › B"
    assert present.location_text(Location(slide=2, title="T")) == "第 2 張投影片「T」"


def test_markdown_and_cuts():
    assert present.markdown_table(["a|b"], [["x\ny"], [None]]) == "| a\\|b |\n| --- |\n| x y |\n|  |"
    assert present.cut_hit("x" * 1501).startswith("x" * 1500 + "…") and present.cut_hit("x") == "x"
    assert "找到 1 筆" in present.search_text([("f", "/f", Location(page=1), "t", "t3")], True)


def test_excerpts_mark_matches():
    terms = present.highlight_terms("報價單 ABC-12 x")
    assert terms == ["報價單", "abc", "12"]
    parts = present.excerpt("a" * 400 + " ABC and 報價單 " + "b" * 400, terms)
    assert [p.text for p in parts if p.marked] == ["ABC", "報價單"] and parts[0].text == parts[-1].text == "…"
    assert [p.marked for p in present.highlight("abcabc", ["abc"])] == [True]
    assert present.table_text("<table>\n<thead>\n<tr><th>h</th></tr>\n</thead>\n<tr><td>v</td></tr>\n</table>") == "h：v"


def test_changelog():
    assert present.changelog("# x\n## 1.2 - 2025-01-02\n- a\n* b\n## 1.1\n- c", 5) == [("1.2", "2025-01-02", ["a", "b"]), ("1.1", None, ["c"])]
    assert [present.relative_time(s) for s in (5, 120, 7200, 200000)] == ["剛剛", "2 分鐘前", "2 小時前", "2 天前"]


def test_service(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "a"), (2, "alpha", "b")], "doc_id long, text string, source string")

    def broken(_):
        raise RuntimeError

    cells = spark.createDataFrame([("1", "x"), ("2", "y")], "n string, v string")
    s = Service(docs, docs, broken, {"t1": (1, lambda: cells)})
    assert [r.degraded for r in s.search("alpha").collect()] == [True, True]
    assert s.search(" ").count() == 0
    assert s.describe_table("t1").columns == [("n", "n", "number"), ("v", "v", "text")]
    with pytest.raises(tables.TableQueryError):
        s.query_table("t9", "SELECT 1")
