"""What callers read: locations, excerpts, result text and one-line summaries (driver side, O(results))."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import segments
from foliant.operators.chunking import PATH, Location

HIT_CHARS, EXCERPT_CHARS, LEAD_CHARS = 1500, 300, 60
# The texts that callers see.
PAGE, SLIDE, SHEET, INSIDE = "第 {} 頁", "第 {} 張投影片", "工作表「{}」", "內嵌："
DEGRADED, NOTHING, FOUND, EMPTY_RESULT, ROWS_FOUND = "（目前只使用關鍵字比對）", "沒有找到相關內容。", "找到 {} 筆相關內容：", "查詢完成，沒有符合的資料列。", "查詢結果共 {} 列："


def location_text(at: Location) -> str:
    shown = lambda x: bool(x and x.strip())
    slide = None if at.slide is None else SLIDE.format(at.slide) + (f"「{at.title}」" if shown(at.title) else "")
    title = f"「{at.title}」" if at.slide is None and shown(at.title) and at.title not in at.heading_path else None
    headings = PATH.join(h for h in at.heading_path if shown(h))
    parts = [SHEET.format(at.sheet) if shown(at.sheet) else None, at.cell_range if shown(at.cell_range) else None, slide, None if at.page is None else PAGE.format(at.page), headings, title]
    main = " · ".join(p for p in parts if p)
    return PATH.join(p for p in (INSIDE + PATH.join(at.embedded_path) if at.embedded_path else "", main) if p)


def table_id(kind: Column, registered: Column) -> Column:
    """``t`` and the number of a registered table, on its summary hits."""
    return F.when(kind == "table_summary", F.concat(F.lit("t"), registered.cast("string")))


def is_embedded_key(key: Column) -> Column:
    return F.contains(key, F.lit(PATH))


def cut_hit(text: str, most: int = HIT_CHARS) -> str:
    return text if len(text) <= most else f"{text[:most]}…（內容太長，已截斷，原文共 {len(text)} 字）"


def markdown_table(columns: list[str], rows: list[list[str | None]]) -> str:
    cell = lambda v: "" if v is None else re.sub(r"\r\n|\r|\n", " ", v.replace("\\", "\\\\").replace("|", "\\|"))
    line = lambda values: "| " + " | ".join(values) + " |"
    return "\n".join([line([cell(c) for c in columns]), line(["---"] * len(columns)), *(line([cell(v) for v in r]) for r in rows)])


def search_text(hits: list[tuple[str, str, Location, str, str | None]], degraded: bool) -> str:
    """hits: file name, path, location, text, table id."""
    out = [DEGRADED] * degraded + [FOUND.format(len(hits)) if hits else NOTHING]
    for n, (name, path, at, text, table) in enumerate(hits, 1):
        where = location_text(at)
        out += ["", f"[{n}] {name} — {where}" if where else f"[{n}] {name}", f"路徑：{path}", "內容：", cut_hit(text)] + [f"table_id: {table}"] * bool(table)
    return "\n".join(out)


def query_text(columns: list[str], rows: list[list[str]], truncated: bool, max_rows: int) -> str:
    out = f"{ROWS_FOUND.format(len(rows)) if rows else EMPTY_RESULT}\n\n{markdown_table(columns, rows)}"
    return out + (f"\n\n（結果超過 {max_rows} 列，只顯示前 {max_rows} 列。）" if truncated else "")


def highlight_terms(query: str) -> list[str]:
    """Words of two characters or more and trigrams of longer CJK runs."""
    from foliant.operators.lexical import is_cjk

    out: dict[str, str] = {}
    for s in segments(unicodedata.normalize("NFKC", query or "")):
        for part in re.split(r"[-_.]+", s):
            pieces = [part[i : i + 3] for i in range(len(part) - 2)] if len(part) > 2 and is_cjk(part) else [part]
            for p in pieces:
                if len(p) >= 2:
                    out.setdefault(p.lower(), p)
    return list(out.values())[:32]


@dataclass(frozen=True)
class Fragment:
    text: str
    marked: bool


def highlight(text: str, terms: list[str]) -> list[Fragment]:
    """Fragments of a text; matches that overlap or touch are one."""
    spans = sorted((m.start(), m.end()) for t in terms for m in re.finditer(f"(?=({re.escape(t)}))", text, re.I) for m in [re.compile(re.escape(t), re.I).match(text, m.start())] if m)
    joined: list[list[int]] = []
    for a, b in spans:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, at = [], 0
    for a, b in joined:
        out += [Fragment(text[at:a], False)] * (a > at) + [Fragment(text[a:b], True)]
        at = b
    return out + [Fragment(text[at:], False)] * (at < len(text))


def table_text(markup: str) -> str:
    """A rendered table as lines of ``header：value`` pairs; other text as it is."""
    if "<table>" not in markup:
        return markup
    import html as entities

    rows = [[entities.unescape(re.sub(r"<br>", " ", c)) for c in re.findall(r"<t[hd][^>]*>(.*?)</t[hd]>", r, re.S)] for r in re.findall(r"<tr>(.*?)</tr>", markup, re.S)]
    n_head = len(re.findall(r"<tr>", (re.search(r"<thead>(.*?)</thead>", markup, re.S) or ["", ""])[1]))
    head = rows[n_head - 1] if n_head else []
    pair = lambda i, v: f"{head[i]}：{v}" if i < len(head) and head[i] else v
    return "\n".join("；".join(pair(i, v) for i, v in enumerate(r) if v) for r in rows[n_head:])


def excerpt(text: str, terms: list[str], most: int = EXCERPT_CHARS) -> list[Fragment]:
    """A window of a hit that shows its first match."""
    plain = re.sub(r"\n{3,}", "\n\n", table_text(text).replace("\r", "")).strip()
    found = [m.start() for t in terms if (m := re.search(re.escape(t), plain, re.I))]
    first = min(found, default=0)
    start = max(0, first - LEAD_CHARS) if first > most - 40 else 0
    dots = Fragment("…", False)
    out = highlight(plain[start : start + most], terms)
    return [dots] * (start > 0) + out + [dots] * (start + most < len(plain))


def changelog(text: str, most: int = 5) -> list[tuple[str, str | None, list[str]]]:
    """(version, date, items) of ``## version - date`` headings with their bullets."""
    out: list[tuple[str, str | None, list[str]]] = []
    for line in (text or "").splitlines():
        if m := re.match(r"##\s+(.+?)(?:\s+[-–—]\s+(\d{4}-\d{2}-\d{2}))?\s*$", line):
            out.append((m[1].strip(), m[2], []))
        elif out and (m := re.match(r"\s*[-*+]\s+(.+?)\s*$", line)):
            out[-1][2].append(m[1])
    return out[: max(0, most)]


def relative_time(seconds: float) -> str:
    for size, name in ((86400, "天"), (3600, "小時"), (60, "分鐘")):
        if seconds >= size:
            return f"{int(seconds // size)} {name}前"
    return "剛剛"
