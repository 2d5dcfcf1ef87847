"""Page differencing against brute force, and what markup may delete inside an article."""

import random

import pytest

from foliant.llm import html_diff


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def pairs_of(rows):
    """Near pages of each page by host and path: groups of equal lines count once."""
    places, groups = {}, {}
    for i, url, page in rows:
        lines = tuple(x for x, _, _ in html_diff.marked_lines(page))
        if lines:
            host, path = html_diff.place_of(url)
            groups[host, lines] = min(groups.get((host, lines), path), path)
            places[i] = (host, lines)
    near = {}
    for host in {h for h, _ in groups}:
        mine = sorted((path, lines) for (h, lines), path in groups.items() if h == host)
        for at, (_, lines) in enumerate(mine):
            near[host, lines] = [x for k in range(1, html_diff.REACH + 1) for n in (at - k, at + k) if 0 <= n < len(mine) for x in [mine[n][1]]]
    return places, near


def test_pairing_and_deletion(shipped):
    rng = random.Random(11)
    template = [f"<div>Template {k}</div>" for k in range(4)]
    rows = []
    for i in range(60):
        body = "".join(f"<div>Own text {i} {k}</div>" for k in range(rng.randint(1, 4)))
        used = "".join(t for t in template if rng.random() < 0.7)
        rows.append((i, f"http://h{i % 3}.x/a/{rng.randint(100, 999)}{i}", f"<body>{used}{body}</body>"))
    rows += [(100 + i, f"http://h0.x/copy/{i}", rows[0][2]) for i in range(5)]
    source = shipped.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_diff.extract(source).collect()}
    places, near = pairs_of(rows)
    changed = 0
    for i, _, page in rows:
        host, lines = places[i]
        others = near[host, lines]
        # Lines occur once a page here, so a common subsequence of lines in order is their overlap.
        assert all(lcs(lines, o) == len(set(lines) & set(o)) for o in others)
        votes = {x: sum(x in o for o in others) for x in lines}
        stay = [x for x in lines if votes[x] < min(html_diff.AGREE, len(others)) or not others]
        text = "\n".join(stay or lines)
        assert got[i] == text
        changed += text != "\n".join(html_diff.lines_of(page)[0])
    assert changed > 40  # without differencing the result is another


@pytest.mark.parametrize(
    ("inner", "stays"),
    [
        ("<section id='discussion'><p>x</p></section>", True), ("<section id='related-work'><p>x</p></section>", True), ("<p class='legal'>x</p>", True), ("<p class='share-price'>x</p>", True), ("<p class='notice'>x</p>", True), ("<div class='social'>x</div>", True),
        ("<div class='header-note'>x</div>", True), ("<div class='comments'><p>x</p></div>", False), ("<div class='ad'>x</div>", False), ("<div id='cookie-notice'>x</div>", False), ("<aside>x</aside>", False), ("<ul class='share-buttons'><li>x</ul>", False),
    ],
)
def test_markup_inside_an_article(inner, stays):
    lines = html_diff.lines_of(f"<article><h1>T</h1><p>Body of the text</p>{inner}</article>")[0]
    assert lines == ["T", "Body of the text", *(["x"] if stays else [])]


def test_a_teaser_is_not_the_article():
    page = "<div><p>A long text of the page itself, outside any landmark</div><article><p>Teaser</article>"
    assert html_diff.lines_of(page)[0] == ["A long text of the page itself, outside any landmark", "Teaser"]


def test_clashing_columns(shipped):
    rows = [(1, "http://h.x/1", "<p>a", "g", 3, "t"), (2, "http://h.x/2", "<p>b", "g", 3, "t")]
    got = html_diff.extract(shipped.createDataFrame(rows, "page_id long, url string, html string, gone string, row int, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and {r.text for r in got.collect()} == {"a", "b"}
