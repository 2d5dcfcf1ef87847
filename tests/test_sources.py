import io
import zipfile

import pytest

from foliant.operators import sync
from foliant.sources import files, html, office, sheets


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


def workbook(rows, extra=""):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="{"n" if isinstance(v, (int, float)) else "inlineStr"}">' + (f"<v>{v}</v>" if isinstance(v, (int, float)) else f"<is><t>{v}</t></is>") + "</c>" for c, v in zip("ABCDEFGH", row, strict=False) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return pack(
        {
            "xl/workbook.xml": f'<workbook {m}><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f"<worksheet {m}><sheetData>{cells}</sheetData>{extra}</worksheet>",
        }
    )


def test_decode():
    assert files.decode("\ufeffa\r\nb\0".encode()) == "a\nb"
    assert files.decode("hello".encode("utf-16")) == "hello"
    assert "報價" in files.decode("客戶報價單總金額與說明文字".encode("cp950"))


def test_markdown():
    got = files.parse_markdown("# A\ntext\n```\n# not\n```\n## B\n\n### C\nmore\n# End")
    assert [s.location.heading_path for s in got] == [("A",), ("A", "B", "C"), ("End",)]


def test_json_xml_and_limit():
    assert files.format_json('{"a": 1, // note\n}') == '{\n  "a": 1\n}' and files.format_json("{x") == "{x"
    assert files.xml_text("<a><b>x</b> <c>y</c></a>") == "x\ny"
    out, cut = files.limit([files.Section("prose", "one\ntwo\nthree"), files.Section("table", "long table")], 9)
    assert (out[0].text, len(out), cut) == ("one\ntwo", 1, True)
    assert files.mask_json({"apiKey": "x", "a": [{"Token": 1, "b": 2}]}) == {"apiKey": "***", "a": [{"Token": "***", "b": 2}]}


def test_html_sections():
    got = html.sections("<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><h1>A</h1><p>one<br>two</p><table><tr><th>h</th></tr><tr><td colspan=2>v &amp; w</td></tr></table><h2>B</h2>end</body></html>")
    assert [(s.kind, s.location.heading_path) for s in got] == [("prose", ("A",)), ("table", ("A",)), ("prose", ("A", "B"))]
    assert "menu" not in got[0].text and 'colspan="2"' in got[1].text and "v &amp; w" in got[1].text and "<thead>" in got[1].text


def test_csv():
    assert sheets.sniff_delimiter("a;b;c\n1;2,5;3\n4;5;6") == ";"
    assert list(sheets.read_csv('a,"b ""q"",\nx"\n1,2', ",")) == [["a", 'b "q",\nx'], ["1", "2"]]
    small = sheets.parse_csv("d/x.csv", "n,v\n1,2\n3,4")
    assert small[0].kind == "table" and "<th>n</th>" in small[0].text
    large = sheets.parse_csv("d/x.csv", "name,amount\n" + "\n".join(f"row {i},{i}" for i in range(300)))
    assert large[0].kind == "table_summary" and large[0].table_key == "x.csv!A1:B301"


def test_xlsx_regions(spark):
    rows = [["客戶", "金額"]] + [[f"c{i}", i] for i in range(250)]
    data = workbook(rows)
    (section,) = sheets.parse_xlsx("b.xlsx", data)
    assert section.kind == "table_summary"
    region = sheets.read_region("b.xlsx", data, section.table_key, 1)
    assert region.columns == ["客戶", "金額"] and region.rows[1] == ["c1", "1"] and len(region.rows) == 250
    assert sheets.region_frame(spark, region).count() == 250


def test_regions_headers_and_merges():
    cell = sheets.SheetCell
    grid = {(1, 1): cell("區域"), (1, 2): cell("營收"), (2, 2): cell("Q1"), (2, 3): cell("Q2"), (3, 1): cell("北"), (3, 2): cell("1", "number"), (3, 3): cell("2", "number")}
    merges = [(1, 2, 1, 3), (1, 1, 2, 1)]
    assert sheets.find_regions(grid, merges) == [(1, 1, 3, 3)]
    h = sheets.detect_header(grid, (1, 1, 3, 3), merges)
    assert h.n_rows == 2 and sheets.header_names(grid, 1, 2, 1, 3, merges) == ["區域", "營收_Q1", "營收_Q2"]
    two = {(r, c): cell("x") for r in (1, 2) for c in (1, 2)} | {(r, c): cell("y") for r in (1, 2) for c in (5, 6)}
    assert len(sheets.find_regions(two, [])) == 2


@pytest.mark.parametrize(("code", "kind"), [("yyyy/m/d", "date"), ("h:mm", "time"), ("[h]:mm", "elapsed"), ("0.0%", "percent"), ("#,##0", "number"), ('"y"0', "number"), ("General", "number")])
def test_number_formats(code, kind):
    assert sheets.classify_format(code) == kind


def test_serial_dates():
    assert sheets.show_number(45662, "date") == ("2025-01-05", "date") and sheets.show_number(0.5, "percent")[0] == "50%"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx():
    body = '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    data = pack({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'})
    got = office.parse_docx(data)
    assert got[0].text == "Title\nBody new" and got[0].location.heading_path == ("Title",) and 'colspan="2"' in got[1].text


def test_pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda i, x, y, t: f'<p:sp><p:nvSpPr><p:cNvPr id="{i}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="9" cy="9"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld {ns}><p:cSld><p:spTree>{shape(2, 900000, 0, "B")}{shape(1, 0, 100, "A")}{shape(3, 0, 900000, "C")}<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="9"/><p:cNvCxnSpPr><a:stCxn id="1"/><a:endCxn id="3"/></p:cNvCxnSpPr></p:nvCxnSpPr></p:cxnSp></p:spTree></p:cSld></p:sld>'
    rel = '<Relationships><Relationship Id="r1" Type="x/slide" Target="slides/s1.xml"/></Relationships>'
    got = office.parse_pptx(pack({"ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rel, "ppt/slides/s1.xml": slide}))
    assert [s.text for s in got] == ["A\nB\nC", "[A] --> [C]"]


def test_rtf_and_pdf():
    assert office.parse_rtf(rb"{\rtf1\ansi\ansicpg1252{\fonttbl x;}Hello \u22577?\'e9\par next}")[0].text == "Hello 報é\nnext"
    pages = [b"BT (Running head) Tj 0 -20 Td (The %s page has a text of its own) Tj ET" % w for w in (b"first", b"second", b"third")]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj << /Length 1 >>\nstream\n%s\nendstream\n" % (i, p) for i, p in enumerate(pages))
    got = office.parse_pdf(data)
    assert [s.location.page for s in got] == [1, 2, 3] and "Running" not in got[0].text


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "~$b.docx").write_text("x")
    (tmp_path / "bad.docx").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.md").write_text("x")
    found, available = files.scan(spark, str(tmp_path))
    assert available and sorted(r.path.rpartition("/")[2] for r in found.collect()) == ["a.txt", "bad.docx"]
    assert files.scan(spark, str(tmp_path / "none"))[1] is False
    got = {r.path.rpartition("/")[2]: r for r in files.parse(spark.read.format("binaryFile").load(str(tmp_path / "*.*"))).collect()}
    assert got["a.txt"].sections[0].text == "hello" and got["bad.docx"].error
    with pytest.raises(ValueError):
        files.default_registry().add(("txt",), None)


def test_repeated_lines(spark):
    rows = [(1, p, i, t) for p in range(4) for i, t in enumerate([f"Report {p}", f"body {'x' * p}"])]
    assert sync.remove_repeated_lines(spark.createDataFrame(rows, "doc long, page long, line long, text string")).count() == 4


def test_requests_fold():
    r = sync.Requests()
    r.paths("a", ["x"])
    r.folder("a")
    r.paths("a", ["y"])
    assert r.take() == ("folder", "a") and r.take() is None
    assert sync.scope(["/a/x"], "/a") == ["/a/x"] and sync.scope(["/b"], "/a") is None
