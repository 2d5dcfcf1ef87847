"""HTML to located sections, and tables to markup."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from foliant.operators.chunking import Location, Section

from .files import decode

# Elements whose content isn't text, and elements that stand on lines of their own.
DROPPED = frozenset("script style noscript nav footer header head template svg iframe object".split())
BLOCK = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MOST_COLSPAN, MOST_ROWSPAN = 200, 1000


@dataclass
class Cell:
    text: str
    rows: int = 1
    columns: int = 1
    head: bool = False


@dataclass
class Table:
    rows: list[list[Cell]] = field(default_factory=list)
    n_head: int = 0
    caption: str | None = None


def render(table: Table) -> str:
    """Markup with spans, a head and breaks; only what the text needs is escaped."""
    esc = lambda t: entities.escape(t, quote=False).replace("\n", "<br>")

    def row(cells: list[Cell], tag: str) -> str:
        span = lambda c: (f' rowspan="{c.rows}"' if c.rows > 1 else "") + (f' colspan="{c.columns}"' if c.columns > 1 else "")
        return "<tr>" + "".join(f"<{tag}{span(c)}>{esc(c.text)}</{tag}>" for c in cells) + "</tr>"

    lines = ["<table>"]
    if table.caption:
        lines.append(f"<caption>{esc(table.caption)}</caption>")
    if table.n_head:
        lines += ["<thead>", *(row(r, "th") for r in table.rows[: table.n_head]), "</thead>"]
    lines += [row(r, "td") for r in table.rows[table.n_head :]]
    return "\n".join([*lines, "</table>"])


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Section] = []
        self.text: list[str] = []
        self.path: list[tuple[int, str]] = []
        self.title = ""
        self.skip: list[str] = []
        self.in_title = False
        self.heading: int | None = None
        self.mark = 0
        self.tables: list[Table] = []
        self.cell: Cell | None = None
        self.in_head = False
        self.head_rows = 0
        self.pre = 0

    def flush(self) -> None:
        lines = [re.sub(r"[ \t\f\v]+", " ", x).strip() if not self.pre else x.rstrip() for x in "".join(self.text).split("\n")]
        body = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
        self.text.clear()
        if body:
            self.out.append(Section("prose", body, Location(heading_path=tuple(t for _, t in self.path), title=self.title or None)))

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag == "title":
            self.in_title = True
        if self.skip or tag in DROPPED:
            if tag not in VOID:
                self.skip.append(tag)
            return
        a = dict(attributes)
        if tag == "table" and not self.tables:
            self.flush()
            self.tables.append(Table())
            self.head_rows, self.in_head = 0, False
        elif self.tables:
            t = self.tables[0]
            if tag == "thead":
                self.in_head = True
            elif tag in ("tbody", "tfoot"):
                self.in_head = False
            elif tag == "caption":
                self.cell = Cell("", head=False)
            elif tag == "tr":
                t.rows.append([])
                self.head_rows += self.in_head
            elif tag in ("td", "th"):
                if not t.rows:
                    t.rows.append([])
                number = lambda k, most: min(most, max(1, int(a[k]))) if (a.get(k) or "").isdigit() else 1
                self.cell = Cell("", number("rowspan", MOST_ROWSPAN), number("colspan", MOST_COLSPAN), tag == "th")
                t.rows[-1].append(self.cell)
            elif tag == "br" and self.cell:
                self.cell.text += "\n"
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.heading, self.mark = int(tag[1]), len(self.text)
        elif tag == "br" or tag in BLOCK:
            self.text.append("\n" if tag in ("br", "li", "tr", "dt", "dd") else "\n\n")
            self.pre += tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if self.tables:
            t = self.tables[0]
            if tag == "table":
                self.tables.pop()
                self.cell = None
                for r in t.rows:
                    for c in r:
                        c.text = "\n".join(" ".join(x.split()) for x in c.text.strip().split("\n"))
                lead = next((i for i, r in enumerate(t.rows) if not r or not all(c.head for c in r)), len(t.rows))
                t.n_head = self.head_rows or lead
                if t.rows and any(c.text for r in t.rows for c in r):
                    self.out.append(Section("table", render(t), Location(heading_path=tuple(x for _, x in self.path), title=self.title or None)))
            elif tag == "caption" and self.cell is not None:
                t.caption = " ".join(self.cell.text.split()) or None
                self.cell = None
            elif tag in ("td", "th"):
                self.cell = None
            elif tag == "thead":
                self.in_head = False
        elif self.heading and tag == f"h{self.heading}":
            title = " ".join("".join(self.text).split())
            self.path[:] = [p for p in self.path if p[0] < self.heading]
            if title:
                self.path.append((self.heading, title))
            self.text.append("\n")
            self.heading = None
        elif tag in BLOCK:
            self.text.append("\n")
            self.pre -= tag == "pre" and self.pre > 0

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title = (self.title + data).strip()
        if self.skip:
            return
        if self.tables:
            if self.cell is not None:
                self.cell.text += data.replace("\n", " ")
            return
        self.text.append(data if self.pre else re.sub(r"\s+", " ", data))


def sections(text: str) -> list[Section]:
    r = _Reader()
    r.feed(text)
    r.close()
    r.flush()
    return r.out


def decode_html(data: bytes) -> str:
    """The charset that the first 4096 bytes name, unless a BOM or valid UTF-8 says otherwise."""
    found = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", data[:4096], re.I)
    if found and not data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        try:
            return data.decode(found[1].decode())
        except (LookupError, UnicodeDecodeError):
            pass
    return decode(data)


def links(text: str) -> list[tuple[str, str]]:
    return [(entities.unescape(h), " ".join(entities.unescape(re.sub(r"<[^>]*>", "", t)).split())) for h, t in re.findall(r"<a\b[^>]*\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", text, re.S | re.I)]
