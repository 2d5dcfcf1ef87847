import base64
import hashlib
import html
import random
import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from foliant.llm import html_diff, warc

FOLDER = "/root/testdata/sf0.001"


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = ([rng.randint(0, rng.choice((2, 6, 20))) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        i, j = html_diff.shared_lines(a, b)
        assert len(i) == best[-1][-1] and [a[x] for x in i] == [b[x] for x in j] and i == sorted(set(i)) and j == sorted(set(j))


def test_articles_come_out_whole(shipped):
    pages = shipped.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in html_diff.extract(pages).collect()}
    for r in pq.read_table(f"{FOLDER}/pages.parquet").to_pylist():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        text = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]].text, got[r["page_id"]].n_chars) == (text, len(text))


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (None, []), ("", []), ("<p>a<p>b", ["a", "b"]), ("<p>x &amp; y &lt;b&gt; &eacute;</p>", ["x & y <b> é"]), ("<div class='sidebar'>s</div><p>t", ["t"]), ("<article>a<div class='comments'><p>c</p></div></article><p>o</p>", ["a"]),
        ("<script>if (a<b) '</p>'</script><p>t</p>", ["t"]), ("<main><h1>T</h1><ul><li>1<li>2</ul></main><footer>f", ["T", "1", "2"]), ("<p>a\n  b<br>c</p>", ["a b c"]), ("<p>open <b>tag", ["open tag"]), ("<!-- <p>no --><p>yes", ["yes"]),
        ("<div class='page has-sidebar'><article><header class='entry-header'><h1>T</h1></header><p>x</p></article></div>", ["T", "x"]), ("<form><p>f</p></form><p>t</p>", ["t"]), ("<p hidden>h</p><div role=banner>b</div><p>t</p>", ["t"]),
    ],
)
def test_lines(page, lines):
    assert html_diff.lines_of(page)[0] == lines


def test_differencing_deletes_the_template(shipped):
    page = lambda i: f"<body><div>Menu line</div><div>Body number {i}<p>More {i}</div><div>Foot line</div></body>"
    rows = [(i, f"http://h.x/a/{i}", page(i)) for i in range(6)] + [(9, None, None), (10, "http://alone.x/", page(10)), (0, "http://h.x/a/0", page(0))]
    got = html_diff.extract(shipped.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 9 and all(text[i] == f"Body number {i}\nMore {i}" for i in range(1, 6))
    assert text[9] == "" and text[10].startswith("Menu line")
    assert html_diff.extract(shipped.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_differencing_acts_beside_an_article(shipped):
    page = lambda i: f"<nav>Menu</nav><div>Shared line</div><div>Own {i}</div><article><p>Quoted<p>Body {i}</article><footer>Foot {i}</footer>"
    lines = html_diff.marked_lines(page(1))
    assert lines == [("Menu", True, False), ("Shared line", False, False), ("Own 1", False, False), ("Quoted", False, True), ("Body 1", False, True), ("Foot 1", True, False)]
    rows = [(i, f"http://h.x/a/{i}", page(i)) for i in range(5)]
    got = html_diff.extract(shipped.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Own {i}\nQuoted\nBody {i}" for i in range(5)}


def test_copies_and_quotes_keep_their_text(shipped):
    page = lambda i, more="": f"<body><div>Menu line</div><div><a href=x>Linked headline {i}</a></div>{more}<div>Body {i}</div><div>Foot line</div></body>"
    quote = "<p>Quoted by two</p>"
    rows = [(i, f"http://h.x/a/{i}", page(i, quote if i in (2, 3) else "")) for i in range(6)]
    rows += [(0, "http://h.x/a/0", page(0)), (10, "http://h.x/a/0?print=1", page(0)), (11, "http://h.x/mirror/0", page(0)), (12, "http://h.x/a/4b", "<div>Menu line</div><div>Foot line</div>")]
    rows += [(20 + i, f"http://same.x/{i}", page(7)) for i in range(3)]
    got = html_diff.extract(shipped.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = lambda i: f"Linked headline {i}\n" + ("Quoted by two\n" if i in (2, 3) else "") + f"Body {i}"
    want = {i: text(i) for i in range(6)} | {10: text(0), 11: text(0), 12: "Menu line\nFoot line"} | {20 + i: f"Menu line\n{text(7)}\nFoot line" for i in range(3)}
    assert len(got) == len(rows) and all((r.text, r.n_chars) == (want[r.page_id], len(r.text)) for r in got)


def test_warc_round_trip(shipped):
    t = pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()
    rows = [(r["page_id"], r["url"], r["html"]) for r in t] + [(1000 + i, "http://x y/é\r\n", t[i % 3]["html"]) for i in range(9)] + [(2000, None, None), (2001, "u", "")]
    index = warc.write(shipped.createDataFrame(rows, "page_id long, url string, html string"))
    records = {r.page_id: r for r in warc.read(index).collect()}
    same = {}
    for i, _, text in rows:
        same.setdefault(text or "", []).append(i)
    for text, ids in same.items():
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        for i in ids:
            r = records[i]
            lead = max(ids)
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(text.encode()), digest, "response" if i == lead else "revisit", None if i == lead else lead)
    assert {r.page_id: bytes(r.payload).decode() for r in warc.payloads(warc.read(index)).collect()} == {i: text or "" for i, _, text in rows}
    some = warc.read(index.filter("page_id IN (3, 2000)")).collect()
    assert {r.page_id for r in some} == {3, 2000}
    assert warc.read(warc.write(shipped.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    small = warc.write(shipped.createDataFrame([(1, "a", "x"), (2, "b", "x")], "page_id long, url string, html string"), least_bytes=5)
    assert {r.record_type for r in small.collect()} == {"response"}


def test_reads_are_coalesced():
    assert warc.ranges([(0, 10), (10, 5), (20, 5), (500, 5)], gap=10, most=100) == [(0, 3, 0, 25), (3, 4, 500, 505)]
    assert warc.ranges([(0, 60), (60, 60)], gap=10, most=100) == [(0, 1, 0, 60), (1, 2, 60, 120)]


def test_pipeline_on_awkward_rows(odd, none, shipped, tmp_path):
    shipped.createDataFrame([(1, "no such words at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (odd.withColumnRenamed("row", "n_chars"), none.withColumnRenamed("row", "n_chars")):
        docs = start
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(shipped, docs, str(tmp_path)).write.parquet(out := str(tmp_path / f"{start is none}-{id(start)}-{n}"))
            if n < 4:
                assert shipped.read.parquet(out).columns == start.columns
            docs = shipped.read.parquet(out)
        if start.columns and start.limit(1).count():
            assert {r.doc_id for r in docs.collect()} >= {4, 6, 7} and docs.filter("NOT round_trip").count() == 0
        else:
            assert docs.count() == 0


def test_pipeline_searches_items_without_an_id(shipped, tmp_path):
    shipped.createDataFrame([(None, "quoted words of an item"), (1, "other words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = shipped.createDataFrame([(1, "a text with quoted words of an item inside"), (2, "a clean text"), (3, "some other words")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.decontaminate(shipped, docs, str(tmp_path)).collect()] == [2]


def test_pipeline_keeps_one_of_each_group(shipped):
    got = corpus_pipeline.run(shipped, FOLDER)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 150 < len(ids) < 200
