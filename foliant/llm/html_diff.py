"""Main text of web pages, with nearest-URL page differencing.

A page becomes text lines, one a block, navigation, adverts and footers included.  Each page is
paired, within its host, with the pages whose URL paths are nearest in order, two on each side;
all their lines are aligned by longest common subsequence, and lines shared with two of them (with
the one, where the host has no more) are the template's and deleted.  Pages of equal lines count
as one, so that copies don't delete each other.  Markup
guards both sides: lines inside an article or main element are the page's own and stay, since two
articles may quote the same passage, and lines inside navigation, headers, footers, asides, forms,
adverts, notices and reader comments (by element, role, class or id) go although no page shares
them.  Where a page has no neighbour, or would lose every line, markup alone decides.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, release, ship

#: Neighbours on each side, how many must share a line, and the parts of a group of copies.
REACH = 2
AGREE = 2
PARTS = 64

# Element names by what they mean for text.
DROPPED = frozenset("nav footer aside form script style noscript template svg iframe object select button textarea dialog menu head title canvas audio video map math datalist".split())
#: Dropped elements whose text no reader sees, so that it is no line.
UNSEEN = DROPPED - frozenset("nav footer aside form button menu".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
LANDMARK = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HINT = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menus?|breadcrumbs?|header|masthead|banner|footer|side-?bar|aside|widgets?|ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|promotion|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay"
    r"|newsletter|subscribe|subscription|sign-?up|log-?in|share|sharing|social|related|recommended|recommendations|trending|comments?|replies|reply|disqus|respond|discussion|pagination|pager|toolbar|skip-?link|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Inside an article only these whole class or id tokens count, and only on containers: parts of a text
#: are often called legal, related-work, share-price or discussion.
CONTAINERS = frozenset("div section ul ol dl table span header".split())
INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar footer newsletter newsletter-signup subscribe subscription sign-up signup cookie-banner cookie-notice cookie-consent "
    "notice notices site-notice popup modal comment comments comment-list comments-area comments-section comment-form reader-comments disqus_thread respond replies related-posts related-articles share-buttons sharing social-share social-links pagination pager skip-link toolbar".split()
)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
LAYOUT = re.compile(r"(?:has|no|with|without|is|show|hide)[-_]", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _is_boilerplate(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    # Names such as "has-sidebar" describe the layout around, not the element.
    hint = " ".join(t for t in f"{found.get('class', '')} {found.get('id', '')}".split() if not LAYOUT.match(t))
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        return bool(re.search(r"(?:^|[\s_-])(?:comments?|reply|ads?|advert\w*|sponsor\w*|promo|related|teaser)(?:$|[\s_-])", hint, re.I))
    if inside:
        return name in CONTAINERS and not INSIDE.isdisjoint(hint.lower().split())
    return bool(HINT.search(hint))


def marked_lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text line, whether it is boilerplate by markup, whether a landmark holds it) in order."""
    if not page:
        return []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, boilerplate, landmark, unseen
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((line, *(stack[-1][1:3] if stack else (False, False))))
            text.clear()

    def close(names: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        upto = m.start() if m else size
        if upto > at and not (stack and stack[-1][3]):
            text.append(page[at:upto])
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA[") and not (stack and stack[-1][3]):
            text.append(entities.escape(m[0][9:].removesuffix("]]>")))
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK or name == "p":
                flush()
            if name in ("td", "th"):
                text.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(s[0] in BLOCK for s in stack[i:]) or (stack[-1][1] and not (i and stack[i - 1][1])):
                        flush()
                    del stack[i:]
                    break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br" and not (stack and stack[-1][3]):
                text.append(" ")
            continue
        if name in BLOCK:
            flush()
            close({"p"}, {"button", "table", "div", "section", "article", "main", "blockquote", "li", "td", "th", "body"})
        if name in ENDS:
            close(*ENDS[name])
        if name in ("td", "th"):
            text.append(" ")
        attributes = m[3] or m[6] or ""
        parent = stack[-1] if stack else ("", False, False, False)
        boilerplate = parent[1] or _is_boilerplate(name, attributes, parent[2])
        if boilerplate and not parent[1]:
            flush()
        landmark = parent[2] or (name in LANDMARK and not boilerplate)
        if attributes.endswith("/") and name in ("svg", "path", "math"):
            continue
        unseen = parent[3] or (boilerplate and (name in UNSEEN or bool(HIDDEN.search(attributes))))
        stack.append((name, boilerplate, landmark, unseen))
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else size
    flush()
    return out


def _by_markup(lines: list[tuple[str, bool, bool]]) -> tuple[list[str], bool]:
    own = [line for line, marked, landmark in lines if landmark and not marked]
    every = [line for line, marked, _ in lines if not marked]
    # An article element of less than half of the text is a teaser and not the page's article.
    return (own, True) if 2 * sum(map(len, own)) >= sum(map(len, every)) and own else (every, False)


def lines_of(page: str | None) -> tuple[list[str], bool]:
    """(text lines that aren't boilerplate by markup, whether they are those of a landmark)."""
    return _by_markup(marked_lines(page))


def own_text(lines: list[tuple[str, bool, bool]], gone: list[int] | None) -> str:
    """The lines that stay, when those at the places of gone are shared (null: no neighbour)."""
    if gone is None:
        return "\n".join(_by_markup(lines)[0])
    out = set(gone)
    text = "\n".join(line for i, (line, marked, landmark) in enumerate(lines) if not marked and (landmark or i not in out))
    return text or "\n".join(_by_markup(lines)[0])


def shared_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of a longest common subsequence in both, by bit vectors of b's width."""
    common = set(a) & set(b)
    if not common:
        return [], []
    ia, ib = [i for i, x in enumerate(a) if x in common], [i for i, x in enumerate(b) if x in common]
    where: dict[int, int] = {}
    for j, i in enumerate(ib):
        where[b[i]] = where.get(b[i], 0) | 1 << j
    full = (1 << len(ib)) - 1
    state, history = full, []
    for i in ia:
        u = state & where[a[i]]
        state = ((state + u) | (state - u)) & full
        history.append(state)
    # A zero bit at j in row i: the common length grows at j.  Walk back along such steps.
    left, right = [], []
    i, j = len(ia) - 1, len(ib) - 1
    while i >= 0 and j >= 0:
        row, above = history[i], history[i - 1] if i else full
        if row >> j & 1:
            j -= 1
        elif not above >> j & 1:
            i -= 1
        else:
            # The step at (i, j) is new in row i: it is made by the last match at or before j.
            left.append(ia[i])
            k = where[a[ia[i]]] & ((1 << (j + 1)) - 1)
            right.append(ib[k.bit_length() - 1])
            j = k.bit_length() - 2
            i -= 1
    return left[::-1], right[::-1]


def place_of(url: str | None) -> tuple[str, str]:
    """(host, path with query) of a URL, as far as it has them."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").removeprefix("www."), f"{parts.path}?{parts.query}" if parts.query else parts.path
    except ValueError:
        return "", url or ""


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"row": batch.column(0).to_pylist(), "host": [], "path": [], "same": [], "part": [], "lines": []}
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            host, path = place_of(url)
            rows["host"].append(host)
            rows["path"].append(path)
            lines = [xxhash.xxh64_intdigest(x) - (1 << 63) for x, _, _ in marked_lines(page)]
            rows["lines"].append(lines)
            rows["same"].append(xxhash.xxh64_intdigest(array("q", lines).tobytes()) - (1 << 63))
        rows["part"] = [xxhash.xxh64_intdigest(x) % PARTS for x in rows["row"]]
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("row", pa.string()), ("host", pa.string()), ("path", pa.string()), ("same", pa.int64()), ("part", pa.int32()), ("lines", pa.list_(pa.int64()))]))
        release()


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For two near pages of a host, what each would lose."""
    for batch in batches:
        rows: dict[str, list] = {"place": [], "gone": []}
        for r in batch.to_pylist():
            rows["place"] += (r["place"], r["to"])
            rows["gone"] += shared_lines(r["lines"], r["lines_b"])
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("place", pa.int64()), ("gone", pa.list_(pa.int32()))]))


def template_lines(keyed: DataFrame) -> DataFrame:
    """(row, gone): which of each page's lines its near pages share, for pages with a neighbour.

    keyed: row (unique), url, html.  Groups of pages with equal lines are sorted by host and path
    over all partitions and numbered; each meets the next ones by its number, also across
    partitions, so the pairs don't depend on them."""
    light = cut(keyed.select("row", "url", "html").mapInArrow(_light, "row string, host string, path string, same long, part int, lines array<long>"), "html-light")
    groups = light.filter(F.size("lines") > 0).groupBy("host", "same").agg(F.min("path").alias("path"), F.first("lines").alias("lines"), F.collect_set("part").alias("parts"))
    # Written before the numbering, which must not be computed twice.
    ordered = cut(groups.orderBy("host", "path", "same").withColumn("at", F.monotonically_increasing_id()), "html-order")
    first, bases = 0, []
    for block, n in sorted(tuple(r) for r in ordered.groupBy(F.shiftright("at", 33)).count().collect()):
        bases.append((block, first))
        first += n
    base = keyed.sparkSession.createDataFrame(bases, "block long, base long")
    placed = ordered.withColumn("block", F.shiftright("at", 33)).join(F.broadcast(base), "block").withColumn("place", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).select("place", "host", "same", "parts", "lines")
    left = placed.select("place", "host", "lines", F.explode(F.array(*(F.col("place") + i for i in range(1, REACH + 1)))).alias("to"))
    right = placed.select(F.col("place").alias("to"), F.col("host").alias("host_b"), F.col("lines").alias("lines_b"))
    lost = left.join(right, "to").filter("host = host_b").select("place", "lines", "to", "lines_b").mapInArrow(_differences, "place long, gone array<int>")
    near = lost.groupBy("place").agg(F.collect_list("gone").alias("near"))
    agreed = near.select("place", F.expr(f"filter(array_distinct(flatten(near)), x -> size(filter(near, y -> array_contains(y, x))) >= least({AGREE}, size(near)))").alias("gone"))
    # A group of copies is dealt out by the parts that its rows have.
    found = placed.select("place", "host", "same", F.col("parts")).join(agreed, "place").select("host", "same", F.explode("parts").alias("part"), "gone")
    return cut(light.select("row", "host", "same", "part").distinct().join(found, ["host", "same", "part"]).select("row", "gone"), "html-gone")


def extract(pages: DataFrame) -> DataFrame:
    """Input: page_id, url, html and any other columns.  Result for each row: page_id, url, text
    (blocks joined by one newline) and n_chars.  A null or empty html gives the empty text; rows
    that repeat a page_id are told apart by their url and html, and equal rows get equal text.  A
    null url counts as a page of the empty host."""
    ship(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = source.withColumn("row", F.concat_ws(":", F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"), F.hex(F.xxhash64("url", "html"))))
    gone = template_lines(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [own_text(marked_lines(page), lost) for page, lost in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
            release()

    joined = keyed.join(gone.dropDuplicates(["row"]), "row", "left").select("page_id", "url", "html", "gone")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
