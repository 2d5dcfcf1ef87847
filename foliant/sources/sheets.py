"""CSV and XLSX cells, regions of a sheet, their headers, and the sections they become."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import chain, count, groupby
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from foliant.functions.values import column_name, parse_range, range_text
from foliant.operators.chunking import Location, Section

from .html import Cell, Table, render

SMALL_CELLS, SAMPLES, SAMPLE_CHARS = 400, 5, 100
WINDOW, MOST_HEADER, MOST_BANNER = 14, 4, 4
TEXT_SHARE, EMPHASIZED_SHARE = 0.6, 0.4
# The lines of a table's summary.
FILE_LINE, SHEET_LINE, CAPTION_LINE, COLUMNS_LINE = "檔案：{}", "工作表：{}（範圍 {}，共 {} 筆資料）", "表格標題：{}", "欄位：{}"
SAMPLES_LINE, SAMPLE_SEPARATOR, CLOSING_LINE = "範例資料：", "；", "（完整內容請使用 query_table 查詢）"


@dataclass(frozen=True)
class SheetCell:
    text: str
    kind: str = "text"  # text, number, date, bool, error
    strong: bool = False


Grid = dict[tuple[int, int], SheetCell]
Rect = tuple[int, int, int, int]  # top, left, bottom, right


@dataclass
class Sheet:
    name: str
    cells: Grid
    merges: list[Rect]
    hidden: bool = False


def sniff_delimiter(text: str, records: int = 20) -> str:
    """Of comma, semicolon and tab the one whose most frequent field count holds for most records."""
    best, chosen = (0.0, 0), ","
    for d in ",;\t":
        counts = []
        for i, r in enumerate(read_csv(text, d)):
            if i == records:
                break
            counts.append(len(r))
        if counts:
            width, n = min(Counter(counts).items(), key=lambda x: (-x[1], -x[0]))
            if width > 1 and (n / len(counts), width) > best:
                best, chosen = (n / len(counts), width), d
    return chosen


def read_csv(text: str, delimiter: str) -> Iterator[list[str]]:
    """Records by RFC 4180: quoted fields may hold delimiters, doubled quotes and line ends."""
    import csv

    csv.field_size_limit(1 << 30)
    yield from csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)


_DATE = re.compile(r"\d{4}[/-]\d{1,2}[/-]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?$")
_NUMBER = re.compile(r"[+-]?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?%?$")


def guess_kind(text: str) -> str:
    t = text.strip()
    return "date" if _DATE.match(t) else "number" if _NUMBER.match(t) else "text"


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def classify_format(code: str) -> str:
    """date, time, elapsed, percent or number, by the first section without literals."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code.split(";")[0])
    if re.search(r"\[(h+|m+|s+)\]", plain, re.I):
        return "elapsed"
    plain = re.sub(r"\[[^\]]*\]", "", plain).lower()
    if plain in ("general", "@", ""):
        return "number"
    # An m beside hours or seconds means minutes.
    day, clock = bool(re.search(r"[ymd]", re.sub(r"h+[^a-z]*m+|m+[^a-z]*s+", "h", plain))), bool(re.search(r"[hs]", plain))
    if day:
        return "date"
    return "time" if clock else "percent" if "%" in plain else "number"


def show_number(value: float, kind: str, date1904: bool = False) -> tuple[str, str]:
    """(display text, cell kind) of a stored number."""
    if kind in ("date", "time"):
        if kind == "time" and 0 <= value < 1:
            seconds = round(value * 86400)
            return f"{seconds // 3600 % 24:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}", "date"
        serial = value + (1462 if date1904 else 0)
        try:
            at = datetime(1899, 12, 30 if serial >= 61 else 31) + timedelta(seconds=round(serial * 86400))
        except OverflowError:
            return f"{value:.15g}", "number"
        return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S"), "date"
    if kind == "elapsed":
        seconds = round(value * 86400)
        return f"{seconds // 3600}:{seconds // 60 % 60:02d}:{seconds % 60:02d}", "text"
    if kind == "percent":
        return f"{value * 100:.15g}%", "number"
    return f"{value:.15g}", "number"


def read_xlsx(data: bytes) -> list[Sheet]:
    """Sheets with their cells: formulas by their stored values; hidden sheets are marked."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        xml = lambda n: ElementTree.fromstring(z.read(n)) if n in names else None
        book = xml("xl/workbook.xml")
        rels = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t") if True) for si in (xml("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else [])]
        formats, strong = _styles(xml("xl/styles.xml"))
        pr = book.find("m:workbookPr", _NS)
        date1904 = pr is not None and pr.get("date1904") in ("1", "true")
        out = []
        for s in book.find("m:sheets", _NS):
            target = rels[s.get(f"{{{_NS['r']}}}id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            sheet = Sheet(s.get("name"), {}, [], s.get("state") in ("hidden", "veryHidden"))
            out.append(sheet)
            if sheet.hidden or path not in names:
                continue
            row = column = 0
            for _, e in ElementTree.iterparse(z.open(path)):
                tag = e.tag.rpartition("}")[2]
                if tag == "row":
                    row = int(e.get("r") or row + 1)
                    column = 0
                    for c in e.iter(f"{{{_NS['m']}}}c"):
                        at = parse_range(c.get("r") or "")
                        column = at[1] if at else column + 1
                        style = int(c.get("s") or 0)
                        cell = _cell(c, shared, formats[style] if style < len(formats) else "number", style in strong, date1904)
                        if cell:
                            sheet.cells[at[0] if at else row, column] = cell
                    e.clear()
                elif tag == "mergeCell" and (rect := parse_range(e.get("ref") or "")):
                    sheet.merges.append(rect)
        return out


def _styles(root: ElementTree.Element | None) -> tuple[list[str], set[int]]:
    if root is None:
        return [], set()
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
    bold = {i for i, f in enumerate(root.iterfind("m:fonts/m:font", _NS)) if f.find("m:b", _NS) is not None}
    filled = {i for i, f in enumerate(root.iterfind("m:fills/m:fill", _NS)) if (p := f.find("m:patternFill", _NS)) is not None and p.get("patternType") not in (None, "none", "gray125")}
    kinds, strong = [], set()
    for i, xf in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)):
        n = int(xf.get("numFmtId") or 0)
        kinds.append(classify_format(own[n]) if n in own else "elapsed" if n == 46 else "time" if n in (18, 19, 20, 21, 45, 47) else "date" if n in DATE_FORMATS else "percent" if n in (9, 10) else "number")
        if int(xf.get("fontId") or 0) in bold or int(xf.get("fillId") or 0) in filled:
            strong.add(i)
    return kinds, strong


def _cell(c: ElementTree.Element, shared: list[str], kind: str, strong: bool, date1904: bool) -> SheetCell | None:
    t, v = c.get("t") or "n", c.find("m:v", _NS)
    if t == "inlineStr":
        text = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
        return SheetCell(text, "text", strong) if text.strip() else None
    if v is None or v.text is None:
        return None
    if t == "s":
        text = shared[int(v.text)]
        return SheetCell(text, "text", strong) if text.strip() else None
    if t == "b":
        return SheetCell("TRUE" if v.text == "1" else "FALSE", "bool", strong)
    if t in ("e", "str", "d"):
        return SheetCell(v.text, {"e": "error", "str": "text", "d": "date"}[t], strong) if v.text.strip() else None
    try:
        return SheetCell(*show_number(float(v.text), kind, date1904), strong)
    except ValueError:
        return SheetCell(v.text, "text", strong)


def find_regions(cells: Grid, merges: list[Rect]) -> list[Rect]:
    """Boxes of connected cells (a merge counts if its anchor has a value), boxes that overlap
    united, and a lone cell one or two rows above a box taken as its caption."""
    filled = set(cells)
    for top, left, bottom, right in merges:
        if (top, left) in cells:
            filled |= {(r, c) for r in range(top, bottom + 1) for c in range(left, right + 1)}
    boxes: list[Rect] = []
    seen: set[tuple[int, int]] = set()
    for start in sorted(filled):
        if start in seen:
            continue
        stack, members = [start], []
        seen.add(start)
        while stack:
            r, c = stack.pop()
            members.append((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in filled and n not in seen:
                    seen.add(n)
                    stack.append(n)
        rows, columns = [r for r, _ in members], [c for _, c in members]
        boxes.append((min(rows), min(columns), max(rows), max(columns)))
    changed = True
    while changed:
        changed = False
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
                    boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    del boxes[j]
                    changed = True
                    break
            if changed:
                break
    for single in sorted(b for b in boxes if b[0] == b[2] and b[1] == b[3]):
        below = [b for b in boxes if b != single and b[0] - single[0] in (1, 2) and b[1] <= single[1] <= b[3] and (b[2] > b[0] or b[3] > b[1])]
        if below:
            near = min(below)
            boxes.remove(single)
            boxes[boxes.index(near)] = (single[0], near[1], near[2], near[3])
    return sorted(boxes)


@dataclass
class Header:
    banner_rows: int
    caption: str | None
    n_rows: int


def _row_letters(rows: list[list[SheetCell | None]], top: int, left: int, merges: list[Rect]) -> str:
    """A letter for each row: ``_`` blank, ``W`` a lone merge at least half as wide as the box with
    ``w`` for the rows it covers, ``L`` a lone cell above a blank row in a box of three columns or
    more, ``x`` anything else."""
    spans = {(m[0] - top, m[1] - left): (m[2] - m[0] + 1, m[3] - m[1] + 1) for m in merges}
    filled = [[i for i, c in enumerate(r) if c] for r in rows]
    letters = ["x" if f else "_" for f in filled]
    for i, f in enumerate(filled):
        if len(f) != 1 or letters[i] == "w":
            continue
        height, width = spans.get((i, f[0]), (1, 0))
        if 2 * width >= len(rows[i]):
            letters[i : i + height] = ["W", *"w" * (min(height, len(rows) - i) - 1)]
        elif not width and len(rows[i]) > 2 and i + 1 < len(rows) and not filled[i + 1]:
            letters[i] = "L"
    return "".join(letters)


def _banner(letters: str) -> tuple[int, list[int]]:
    """(rows of the banner, those with its captions), read off the letters: wide merges and lone
    cells, with blank rows between and after them, that begin in the first rows."""
    end, captions = 0, []
    for m in re.finditer("[WL]w*|_", letters):
        fits = m.start() == end < min(MOST_BANNER, len(letters) - 1) and m.end() <= 2 * MOST_BANNER
        if not fits or (m[0] == "_" and not end):
            break
        end = m.end()
        captions += [m.start()] * (m[0] != "_")
    return min(end, len(letters) - 1), captions


def _header_rows(rows: list[list[SheetCell | None]], tops: set[int]) -> int:
    """How many of the rows are a header.

    Columns of row statistics decide at once for every possible number of rows: all rows above
    the split are mostly text, the row below is less so or mostly numbers, and several rows are
    levels only with a merge (``tops``: rows that hold one) or with fewer cells at the top."""
    full = [[c for c in r if c] for r in rows]
    size = np.array([len(f) for f in full])
    share = lambda holds: np.array([sum(map(holds, f)) for f in full]) / np.maximum(size, 1)
    text, number = share(lambda c: c.kind == "text"), share(lambda c: c.kind in ("number", "date"))
    strong = share(lambda c: c.strong) > 0.5
    worded = np.logical_and.accumulate((size > 0) & (text >= np.where(strong, EMPHASIZED_SHARE, TEXT_SHARE)))
    if len(rows) < 2 or not worded[0]:
        return 0
    turns = (text[1:] < text[:-1]) | (number[1:] > 0.5)
    merged = np.logical_or.accumulate([i in tops for i in range(len(rows))])
    levels = merged | ((size[0] >= 2) & (size[0] < size))
    levels[0] = True
    split = np.flatnonzero((worded[:-1] & turns & levels[:-1])[:MOST_HEADER])
    return int(split[0]) + 1 if len(split) else int(strong[0] and not strong[1])


def detect_header(cells: Grid, box: Rect, merges: list[Rect]) -> Header:
    """The banner and header rows at the top of a box."""
    top, left, bottom, right = box
    rows = [[cells.get((r, c)) for c in range(left, right + 1)] for r in range(top, min(bottom, top + WINDOW - 1) + 1)]
    banner, captions = _banner(_row_letters(rows, top, left, merges))
    caption = " ".join(clean(next(c for c in rows[i] if c).text) for i in captions) or None
    first = top + banner
    tops = {m[0] - first for m in merges if m[0] >= first and m[:2] != m[2:]}
    return Header(banner, caption, _header_rows(rows[banner : banner + MOST_HEADER + 1], tops))


def clean(text: str) -> str:
    return " ".join(p.strip() for p in re.split(r"[\r\n\t]", text) if p.strip())


def header_names(cells: Grid, top: int, n_rows: int, left: int, right: int, merges: list[Rect]) -> list[str]:
    """Levels joined by ``_`` with merges filled in; blank names are 欄 and the letter; repeats are numbered."""
    levels = range(top, top + n_rows)
    spread = {(r, c): m[:2] for m in merges if m[0] in levels for r in levels if m[0] <= r <= m[2] for c in range(max(left, m[1]), min(right, m[3]) + 1)}

    def label(at: tuple[int, int]) -> str:
        return clean(cells[at].text) if at in cells and left <= at[1] <= right else ""

    taken: set[str] = set()
    names = []
    for c in range(left, right + 1):
        path = filter(None, (label(spread.get((r, c), (r, c))) or label((r, c)) for r in levels))
        base = "_".join(k for k, _ in groupby(path)) or f"欄{column_name(c)}"
        names.append(next(n for n in chain([base], (f"{base}_{i}" for i in count(2))) if n.lower() not in taken))
        taken.add(names[-1].lower())
    return names


def small_table(cells: Grid, box: Rect, merges: list[Rect], n_head: int, caption: str | None) -> Table:
    """A box as a table with spans; blank rows and columns go if the box is much larger than small."""
    top, left, bottom, right = box
    anchors = {(m[0], m[1]): m for m in merges}
    covered = {(r, c) for m in merges for r in range(m[0], m[2] + 1) for c in range(m[1], m[3] + 1)} - set(anchors)
    rows, columns = list(range(top, bottom + 1)), list(range(left, right + 1))
    if len(rows) * len(columns) > 4 * SMALL_CELLS:
        rows = [r for r in rows if any((r, c) in cells for c in columns)]
        columns = [c for c in columns if any((r, c) in cells for r in rows)]
    out = []
    for r in rows:
        line = []
        for c in columns:
            if (r, c) in covered:
                continue
            m = anchors.get((r, c), (r, c, r, c))
            cell = cells.get((r, c))
            line.append(Cell(cell.text if cell else "", sum(m[0] <= x <= m[2] for x in rows), sum(m[1] <= x <= m[3] for x in columns)))
        out.append(line)
    return Table(out, n_head, caption)


@dataclass
class Region:
    """A registered table: its key, header and rows of display strings."""

    key: str
    sheet: str
    box: Rect
    n_header: int
    columns: list[str]
    rows: list[list[str | None]]
    caption: str | None

    def summary(self, file: str) -> str:
        def shown(value: str | None) -> str:
            text = clean(value or "")
            return text if len(text) <= SAMPLE_CHARS else text[:SAMPLE_CHARS] + "…"

        samples = [SAMPLE_SEPARATOR.join(f"{n}={shown(v)}" for n, v in zip(self.columns, row, strict=True)) for row in self.rows[:SAMPLES]]
        caption = [CAPTION_LINE.format(self.caption)] if self.caption else []
        return "\n".join([FILE_LINE.format(file), SHEET_LINE.format(self.sheet, range_text(*self.box), len(self.rows)), *caption, COLUMNS_LINE.format("、".join(self.columns)), SAMPLES_LINE, *samples, CLOSING_LINE])


def region_of(sheet: Sheet, box: Rect) -> Region:
    h = detect_header(sheet.cells, box, sheet.merges)
    top, left, bottom, right = box
    if h.banner_rows:  # columns that only the banner filled go
        used = [c for r, c in sheet.cells if top + h.banner_rows <= r <= bottom and left <= c <= right]
        left, right = (min(used), max(used)) if used else (left, right)
    top += h.banner_rows
    names = header_names(sheet.cells, top, h.n_rows, left, right, sheet.merges)
    rows = [[c.text if (c := sheet.cells.get((r, x))) else None for x in range(left, right + 1)] for r in range(top + h.n_rows, bottom + 1)]
    return Region(f"{sheet.name}!{range_text(top, left, bottom, right)}", sheet.name, (top, left, bottom, right), h.n_rows, names, rows, h.caption)


def parse_sheet(file: str, sheet: Sheet, one_region: bool = False) -> tuple[list[Section], list[Region]]:
    """A small sheet, or a small region of a larger one, is a whole table; others are registered
    and stand as a summary."""
    if not sheet.cells:
        return [], []
    rows, columns = [r for r, _ in sheet.cells], [c for _, c in sheet.cells]
    whole = (min(rows), min(columns), max(rows), max(columns))
    area = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
    boxes = [whole] if one_region or area(whole) <= SMALL_CELLS else find_regions(sheet.cells, sheet.merges)
    sections, regions = [], []
    for box in boxes:
        at = Location(sheet=sheet.name, cell_range=range_text(*box))
        if area(box) <= SMALL_CELLS:
            h = detect_header(sheet.cells, box, sheet.merges)
            body = (box[0] + h.banner_rows, *box[1:]) if h.caption else box
            sections.append(Section("table", render(small_table(sheet.cells, body, sheet.merges, h.n_rows, h.caption)), at))
        else:
            region = region_of(sheet, box)
            regions.append(region)
            sections.append(Section("table_summary", region.summary(file), Location(sheet=sheet.name, cell_range=range_text(*region.box)), table_key=region.key))
    return sections, regions


def csv_sheet(path: str, text: str) -> Sheet:
    name = path.replace("\\", "/").rpartition("/")[2]
    cells = {(r, c): SheetCell(v, guess_kind(v)) for r, record in enumerate(read_csv(text, sniff_delimiter(text)), 1) for c, v in enumerate(record, 1) if v.strip()}
    return Sheet(name, cells, [])


def parse_csv(path: str, text: str) -> list[Section]:
    return parse_sheet(path, csv_sheet(path, text), True)[0]


def parse_xlsx(path: str, data: bytes) -> list[Section]:
    return [s for sheet in read_xlsx(data) if not sheet.hidden for s in parse_sheet(path, sheet)[0]]


def read_region(path: str, data: bytes, key: str, n_header: int) -> Region:
    """A registered region again, from its sheet, range and number of header rows."""
    from .files import decode

    name, _, where = key.rpartition("!")
    box = parse_range(where)
    sheets = [csv_sheet(path, decode(data))] if path.lower().endswith(".csv") else read_xlsx(data)
    sheet = next((s for s in sheets if s.name == name), None)
    if sheet is None or box is None:
        raise LookupError(f"{key} isn't in {path} any more")
    top, left, bottom, right = box
    names = header_names(sheet.cells, top, n_header, left, right, sheet.merges)
    rows = [[c.text if (c := sheet.cells.get((r, x))) else None for x in range(left, right + 1)] for r in range(top + n_header, bottom + 1)]
    return Region(key, name, box, n_header, names, rows, None)


def region_frame(spark: SparkSession, region: Region) -> DataFrame:
    """A region's display strings as a DataFrame, for :mod:`foliant.operators.tables`."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in region.columns)
    return spark.createDataFrame([tuple(r) for r in region.rows], schema)


