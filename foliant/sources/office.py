"""Word, PowerPoint, RTF and PDF files to located sections, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections import Counter
from dataclasses import dataclass
from xml.etree import ElementTree

from foliant.operators.chunking import Location, Section

from .html import Cell, Table, render

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
HEADING_CHARS, INCH = 40, 914400


def _parts(data: bytes) -> tuple[zipfile.ZipFile, set[str]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    return z, set(z.namelist())


def _relations(z: zipfile.ZipFile, names: set[str], part: str) -> dict[str, tuple[str, str]]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in names:
        return {}
    out = {}
    for r in ElementTree.fromstring(z.read(path)):
        target = r.get("Target") or ""
        stack = [] if target.startswith("/") else folder.split("/")
        for step in target.strip("/").split("/"):
            stack = stack[:-1] if step == ".." else [*stack, step]
        out[r.get("Id")] = ((r.get("Type") or "").rpartition("/")[2], "/".join(stack))
    return out


def _word_text(p: ElementTree.Element) -> str:
    """A paragraph as if its tracked changes were accepted; field codes and deletions don't show."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        tag = e.tag.removeprefix(W)
        if tag in ("del", "moveFrom", "instrText", "delText", "pPr", "rPr"):
            return
        if tag == "t":
            out.append(e.text or "")
        elif tag == "tab":
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")
        elif tag == "noBreakHyphen":
            out.append("-")
        for child in e:
            if not (child.tag == f"{W}p" and e is not p):
                walk(child)

    walk(p)
    return "".join(out)


def _word_table(t: ElementTree.Element) -> Table:
    """Grid spans and vertical merges as spans; the first row is a head at least."""
    rows: list[list[Cell]] = []
    open_merges: dict[int, Cell] = {}
    n_head = 0
    for tr in t.iterfind(f"{W}tr"):
        line, column = [], 0
        if tr.find(f"{W}trPr/{W}tblHeader") is not None and n_head == len(rows):
            n_head += 1
        for tc in tr.iterfind(f"{W}tc"):
            span = tc.find(f"{W}tcPr/{W}gridSpan")
            width = int(span.get(f"{W}val")) if span is not None else 1
            merge = tc.find(f"{W}tcPr/{W}vMerge")
            text = "\n".join(x for x in (_word_text(p).strip() for p in tc.iterfind(f"{W}p")) if x)
            if merge is not None and merge.get(f"{W}val") != "restart" and column in open_merges:
                open_merges[column].rows += 1
            else:
                cell = Cell(text, 1, width)
                line.append(cell)
                open_merges.pop(column, None)
                if merge is not None:
                    open_merges[column] = cell
            column += width
        rows.append(line)
    return Table(rows, max(1, n_head) if len(rows) > 1 else n_head)


def _size(p: ElementTree.Element) -> tuple[int | None, bool]:
    """(largest font size of a paragraph in half points, whether all its runs are bold)."""
    runs = [r for r in p.iter(f"{W}r") if any((t.text or "").strip() for t in r.iter(f"{W}t"))]
    sizes = [int(s.get(f"{W}val")) for r in runs for s in r.iterfind(f"{W}rPr/{W}sz")]
    off = ("0", "false", "off")
    bold = bool(runs) and all((b := r.find(f"{W}rPr/{W}b")) is not None and b.get(f"{W}val") not in off for r in runs)
    return (max(sizes) if sizes else None), bold


def parse_docx(data: bytes) -> list[Section]:
    """Sections by heading style, or by bold short lines set larger than the usual size."""
    z, names = _parts(data)
    with z:
        levels: dict[str, int] = {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iterfind(f"{W}style"):
                name = s.find(f"{W}name")
                m = re.fullmatch(r"(?:heading|標題) ?([1-9])", (name.get(f"{W}val") if name is not None else "").lower())
                outline = s.find(f"{W}pPr/{W}outlineLvl")
                if m:
                    levels[s.get(f"{W}styleId")] = int(m[1])
                elif outline is not None and int(outline.get(f"{W}val")) < 9:
                    levels[s.get(f"{W}styleId")] = int(outline.get(f"{W}val")) + 1
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        notes = []
        for part in ("footnotes", "endnotes", "comments"):
            if f"word/{part}.xml" in names:
                for n in ElementTree.fromstring(z.read(f"word/{part}.xml")):
                    if n.get(f"{W}type") in (None, "normal") and (t := "\n".join(_word_text(p) for p in n.iter(f"{W}p")).strip()):
                        notes.append(t)
    blocks = [e for e in body.iter() if e.tag in (f"{W}p", f"{W}tbl")]
    inner = {id(x) for t in blocks if t.tag == f"{W}tbl" for x in t.iter() if x is not t}
    blocks = [b for b in blocks if id(b) not in inner]
    weight: Counter[int] = Counter()
    for b in blocks:
        if b.tag == f"{W}p" and (s := _size(b)[0]):
            weight[s] += len(_word_text(b))
    usual = min(weight.items(), key=lambda x: (-x[1], x[0]))[0] if weight else None
    out: list[Section] = []
    path: list[tuple[int, str]] = []
    lines: list[str] = []

    def flush() -> None:
        if "".join(lines).strip():
            out.append(Section("prose", "\n".join(lines).strip(), Location(heading_path=tuple(t for _, t in path))))
        lines.clear()

    for i, b in enumerate(blocks):
        if b.tag == f"{W}tbl":
            flush()
            table = _word_table(b)
            if any(c.text for r in table.rows for c in r):
                out.append(Section("table", render(table), Location(heading_path=tuple(t for _, t in path))))
            continue
        text = _word_text(b).strip()
        style = b.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val") if style is not None else ""
        if not text or name.lower().startswith("toc"):
            continue
        level = levels.get(name)
        size, bold = _size(b)
        if level is None and bold and size and usual and size > usual and len(text) <= HEADING_CHARS and i + 1 < len(blocks):
            level = 1
        if level:
            flush()
            path[:] = [p for p in path if p[0] < level] + [(level, text)]
            lines.append(text)
        else:
            item = b.find(f"{W}pPr/{W}numPr")
            depth = item.find(f"{W}ilvl") if item is not None else None
            lines.append("  " * int(depth.get(f"{W}val") if depth is not None else 0) + "- " + text if item is not None else text)
    flush()
    return out + [Section("notes", n) for n in notes]


@dataclass
class _Shape:
    id: str
    x: int
    y: int
    width: int
    height: int
    text: str = ""
    table: Table | None = None
    link: tuple[str, str] | None = None
    is_title: bool = False
    chart: str | None = None


def reading_order(shapes: list[_Shape]) -> list[_Shape]:
    """Rows from the top, with a tolerance of 0.3 of the height between 0.1 and 0.5 inch; then from the left."""
    rows: list[list[_Shape]] = []
    for s in sorted(shapes, key=lambda s: (s.y, s.x)):
        near = min(max(0.3 * s.height, 0.1 * INCH), 0.5 * INCH)
        if rows and abs(s.y - rows[-1][0].y) <= near:
            rows[-1].append(s)
        else:
            rows.append([s])
    return [s for r in rows for s in sorted(r, key=lambda s: s.x)]


def _drawn(e: ElementTree.Element) -> str:
    return "\n".join(x for x in ("".join(t.text or "" if t.tag == f"{A}t" else "\n" for t in p.iter() if t.tag in (f"{A}t", f"{A}br")).strip() for p in e.iter(f"{A}p")) if x)


def _shapes(tree: ElementTree.Element) -> list[_Shape]:
    out = []
    for e in tree.iter():
        if e.tag not in (f"{P}sp", f"{P}cxnSp", f"{P}graphicFrame"):
            continue
        box = e.find(f"{P}spPr/{A}xfrm") if e.tag != f"{P}graphicFrame" else e.find(f"{P}xfrm")
        off, ext = (box.find(f"{A}off"), box.find(f"{A}ext")) if box is not None else (None, None)
        number = lambda x, k: int(x.get(k)) if x is not None else 0
        name = next(e.iter(f"{P}cNvPr"), None)
        s = _Shape(name.get("id") if name is not None else "", number(off, "x"), number(off, "y"), number(ext, "cx"), number(ext, "cy"))
        holder = next(e.iter(f"{P}ph"), None)
        s.is_title = holder is not None and holder.get("type") in ("title", "ctrTitle")
        if e.tag == f"{P}cxnSp":
            a, b = next(e.iter(f"{A}stCxn"), None), next(e.iter(f"{A}endCxn"), None)
            if a is not None and b is not None:
                s.link = a.get("id"), b.get("id")
                s.text = _drawn(e)
        elif (t := next(e.iter(f"{A}tbl"), None)) is not None:
            rows = []
            for tr in t.iterfind(f"{A}tr"):
                rows.append([Cell(_drawn(c), int(c.get("rowSpan") or 1), int(c.get("gridSpan") or 1)) for c in tr.iterfind(f"{A}tc") if c.get("hMerge") != "1" and c.get("vMerge") != "1"])
            s.table = Table(rows, 1 if len(rows) > 1 else 0)
        elif (c := next(e.iter(f"{C}chart"), None)) is not None:
            s.chart = c.get(f"{R}id")
        else:
            s.text = _drawn(e)
        out.append(s)
    return out


def connectors(shapes: list[_Shape]) -> list[str]:
    """``[A] --> [B]`` lines of the arrows between shapes with text."""
    names = {s.id: " ".join(s.text.split()) for s in shapes if s.text and not s.link}
    out = []
    for s in shapes:
        if s.link and s.link[0] in names and s.link[1] in names:
            label = f"--({' '.join(s.text.split())})-->" if s.text else "-->"
            out.append(f"[{names[s.link[0]]}] {label} [{names[s.link[1]]}]")
    return out


def _chart(root: ElementTree.Element) -> Table | None:
    """The values a chart keeps, a row for each category."""
    series = []
    for ser in root.iter(f"{C}ser"):
        points = lambda k: {int(p.get("idx")): p.findtext(f"{C}v") or "" for p in ser.iterfind(f"{C}{k}//{C}pt")}
        name = next((v.text or "" for v in ser.iterfind(f"{C}tx//{C}v")), "")
        series.append((name, points("cat") or points("xVal"), points("val") or points("yVal")))
    if not series:
        return None
    keys = sorted({k for _, c, v in series for k in (*c, *v)})
    label = lambda k: next((c[k] for _, c, _ in series if k in c), "")
    rows = [[Cell(""), *(Cell(n) for n, _, _ in series)]] + [[Cell(label(k)), *(Cell(v.get(k, "")) for _, _, v in series)] for k in keys]
    return Table(rows, 1)


def parse_pptx(data: bytes) -> list[Section]:
    """A slide's text in reading order, its tables, charts, arrows and notes."""
    z, names = _parts(data)
    out: list[Section] = []
    with z:
        show = "ppt/presentation.xml"
        rels = _relations(z, names, show)
        order = [rels[s.get(f"{R}id")][1] for s in ElementTree.fromstring(z.read(show)).iter(f"{P}sldId") if s.get(f"{R}id") in rels]
        for number, part in enumerate(order, 1):
            root = ElementTree.fromstring(z.read(part))
            own = _relations(z, names, part)
            shapes = _shapes(root)
            title = next((" ".join(s.text.split()) for s in shapes if s.is_title and s.text), None)
            at = Location(slide=number, title=title)
            hidden = "（隱藏）" if root.get("show") == "0" else ""
            text = [s.text for s in reading_order([s for s in shapes if s.text and not s.link])]
            if text:
                out.append(Section("slide", "\n".join(text) + hidden, at))
            out += [Section("table", render(s.table), at) for s in shapes if s.table and s.table.rows]
            for s in shapes:
                if s.chart and s.chart in own and own[s.chart][1] in names and (t := _chart(ElementTree.fromstring(z.read(own[s.chart][1])))):
                    out.append(Section("table", render(t), at))
            for kind, target in own.values():
                if kind == "diagramData" and target in names:
                    tree = [_drawn(p) for p in ElementTree.fromstring(z.read(target)).iter() if p.tag.endswith("}pt")]
                    if any(tree):
                        out.append(Section("diagram", "\n".join(f"- {' '.join(x.split())}" for x in tree if x), at))
                elif kind == "notesSlide" and target in names:
                    notes = [s.text for s in _shapes(ElementTree.fromstring(z.read(target))) if s.text and not s.text.strip().isdigit()]
                    if notes:
                        out.append(Section("notes", "\n".join(notes), at))
            if arrows := connectors(shapes):
                out.append(Section("diagram", "\n".join(arrows), at))
    return out


def rtf_text(data: bytes) -> str:
    """The text of an RTF file; hidden destinations don't show."""
    text = data.decode("latin-1")
    page = (re.search(r"\\ansicpg(\d+)", text) or ["", "1252"])[1]
    out: list[str] = []
    raw = bytearray()
    stack: list[tuple[bool, int]] = []
    hidden, skip, pending = False, 1, 0

    def flush() -> None:
        if raw:
            try:
                out.append(bytes(raw).decode(f"cp{page}", "replace"))
            except LookupError:
                out.append(bytes(raw).decode("cp1252", "replace"))
            raw.clear()

    for m in re.finditer(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)", text, re.S):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((hidden, skip))
        elif brace == "}":
            hidden, skip = stack.pop() if stack else (False, 1)
        elif hidden:
            continue
        elif word:
            if word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "themedata", "generator", "listtable", "header", "footer"):
                hidden = True
            elif word in ("par", "line", "row", "sect", "page"):
                flush()
                out.append("\n")
            elif word in ("tab", "cell"):
                flush()
                out.append("\t")
            elif word == "uc":
                skip = int(number or 1)
            elif word == "u":
                flush()
                out.append(chr(int(number) % 65536))
                pending = skip
        elif code:
            if pending:
                pending -= 1
            else:
                raw.append(int(code, 16))
        elif sign == "*":
            hidden = True
        elif sign:
            raw += {"~": b" ", "_": b"-"}.get(sign, sign.encode("latin-1") if sign in "\\{}" else b"")
        elif plain:
            cut = min(pending, len(plain))
            pending -= cut
            raw += plain[cut:].encode("latin-1")
    flush()
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse_rtf(data: bytes) -> list[Section]:
    text = re.sub(r"\n{3,}", "\n\n", rtf_text(data)).strip()
    return [Section("prose", text)] if text else []


def pdf_pages(data: bytes) -> list[str]:
    """Text of content streams with simple encodings, a page each; compressed by Flate at most.
    Composite fonts without a simple encoding give no text (no PDF library is at hand)."""
    streams = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if re.search(rb"\bBT\b", body) and re.search(rb"\bT[jJ]\b|'", body):
            streams.append(body)
    return [_pdf_text(s) for s in streams]


def _pdf_text(stream: bytes) -> str:
    escape = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def literal(raw: bytes) -> str:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else b"" if m[1] in (b"\n", b"\r\n") else escape.get(m[1], m[1]), raw, flags=re.S)
        return raw.decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")

    out: list[str] = []
    for m in re.finditer(rb"\((?:\\.|[^\\()])*\)|\[(?:\((?:\\.|[^\\()])*\)|[^\]])*\]\s*TJ|(-?[\d.]+)\s+(-?[\d.]+)\s+T[dD]\b|T\*|\bET\b|[\d.]+\s+Tf", stream, re.S):
        t = m[0]
        if t.startswith(b"("):
            out.append(literal(t[1:-1]))
        elif t.startswith(b"["):
            for part in re.finditer(rb"\(((?:\\.|[^\\()])*)\)|(-?[\d.]+)", t, re.S):
                out.append(literal(part[1]) if part[1] is not None else " " if float(part[2]) < -200 else "")
        elif (m[2] and float(m[2]) != 0) or t in (b"T*", b"ET"):
            out.append("\n")
    return "\n".join(" ".join(x.split()) for x in "".join(out).split("\n") if x.strip())


def join_lines(lines: list[str]) -> str:
    """Lines of a block as one: no space between CJK characters, and a hyphen at the end goes."""
    out = ""
    for x in (t.strip() for t in lines):
        if not out:
            out = x
        elif out.endswith("-") and len(out) > 1 and out[-2].isalpha():
            out = out[:-1] + x
        else:
            wide = ord(out[-1]) > 0x2E7F and x and ord(x[0]) > 0x2E7F
            out += x if wide else " " + x
    return out


def parse_pdf(data: bytes) -> list[Section]:
    """A section for each page, without lines that most pages repeat; pages with fewer than 20
    characters are taken for scans."""
    pages = [p.split("\n") for p in pdf_pages(data)]
    key = lambda x: re.sub(r"[\d\s]+", "", x.lower())
    seen = Counter(k for p in pages for k in {key(x) for x in p} if k)
    often = {k for k, n in seen.items() if len(pages) >= 3 and n * 2 > len(pages)}
    out = []
    for number, lines in enumerate(pages, 1):
        text = "\n".join(x for x in lines if key(x) not in often).strip()
        if len(re.sub(r"\s", "", text)) >= 20:
            out.append(Section("prose", text, Location(page=number)))
    return out
