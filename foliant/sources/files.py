"""Folder scans with their rules, text decoding, and parsers of plain formats."""

from __future__ import annotations

import json
import re
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunking import Location, Section
from foliant.shipping import ship

# Extensions of each category, and what is never scanned.
CATEGORIES = {
    "word": ("docx",), "excel": ("xlsx", "xlsm", "csv"), "powerpoint": ("pptx",), "pdf": ("pdf",),
    "text": ("txt", "md", "markdown", "log", "rtf"), "web": ("html", "htm"), "data": ("json", "xml"),
}
SKIPPED_FOLDERS = ("node_modules", "bin", "obj", "__pycache__", "$recycle.bin", "system volume information")
SKIPPED_FILES = r"(?i)^(~\$.*|thumbs\.db|desktop\.ini|.*\.(tmp|lnk|exe|dll|sys|ini|db|db-wal|db-shm|db-journal))$"
MOST_FILE_BYTES, MOST_CHARS, MOST_EMBEDDED_BYTES, EMBEDDED_DEPTH = 50 << 20, 5_000_000, 50 << 20, 3
PARSE_SECONDS = 120.0


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def category(path: Column) -> Column:
    ext, out = extension(path), F.lit(None).cast("string")
    for name, exts in CATEGORIES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def is_excluded(path: Column) -> Column:
    """Dot folders, build folders, temporary and system files."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    folder = F.exists(folders, lambda p: (p.startswith(".") & (p != ".") & (p != "..")) | p.isin(*SKIPPED_FOLDERS))
    return folder | F.element_at(parts, -1).rlike(SKIPPED_FILES)


def scan(spark: SparkSession, root: str, *, categories: list[str] | None = None, excluded: DataFrame | None = None, most_bytes: int = MOST_FILE_BYTES, paths: list[str] | None = None) -> tuple[DataFrame, bool]:
    """(files, available): path, size, mtime, too_large; contents aren't read.

    A root that can't be reached gives no files and available=False, which is never a deletion."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    try:
        available = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    except Exception:
        available = False
    if not available:
        return spark.createDataFrame([], "path string, size long, mtime timestamp, too_large boolean"), False
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths or [root]).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    wanted = [e for c in categories or CATEGORIES for e in CATEGORIES[c]]
    below = F.substring(F.col("path"), F.locate(root.rstrip("/"), F.col("path")) + len(root.rstrip("/")), F.length("path"))
    files = files.filter(extension(F.col("path")).isin(*wanted) & ~is_excluded(below))
    if excluded is not None:
        from foliant.operators.store import without_prefix

        files = without_prefix(files, "path", excluded)
    return files.withColumn("too_large", F.col("size") > most_bytes), True


def decode(data: bytes) -> str:
    """BOM, else strict UTF-8, else a confident guess, else Big5; one kind of line end, no NUL."""
    for bom, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(bom):
            text = data[len(bom) :].decode(name, "replace")
            break
    else:
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            text = _guess(data)
    return text.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")


def _guess(data: bytes) -> str:
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return data.decode("cp950", "replace")
    best = from_bytes(data).best()
    return data.decode("cp950", "replace") if best is None or best.chaos > 0.5 else str(best)


def parse_text(text: str, is_log: bool = False, most: int = MOST_CHARS) -> list[Section]:
    """A log that is too long keeps its end, other text its beginning up to a line end."""
    if len(text) > most:
        text = text[-most:].partition("\n")[2] if is_log else cut_at_line(text, most)
    return [Section("prose", text)] if text.strip() else []


def cut_at_line(text: str, most: int) -> str:
    end = text.rfind("\n", 0, most + 1)
    return text[: end if end > 0 else most]


def limit(sections: list[Section], most: int = MOST_CHARS) -> tuple[list[Section], bool]:
    """Sections up to a total size; prose is cut at a line end, tables never; and whether any went."""
    out: list[Section] = []
    left = most
    for s in sections:
        if len(s.text) <= left:
            out.append(s)
            left -= len(s.text)
            continue
        if s.kind == "prose" and left > 0 and (part := cut_at_line(s.text, left)).strip():
            out.append(Section(s.kind, part, s.location, s.keep_whole, s.table_key))
        return out, True
    return out, False


def parse_markdown(text: str) -> list[Section]:
    """A section for each ATX heading with its path; fences hide headings; a heading without
    text is dropped except at the end."""
    out: list[Section] = []
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = ""

    def flush(last: bool = False) -> None:
        body = "\n".join(lines).strip("\n")
        alone = len([x for x in lines if x.strip()]) == 1 and bool(re.match(r" {0,3}#{1,6}\s", lines[0] if lines else ""))
        if body.strip() and (last or not alone):
            out.append(Section("prose", body, Location(heading_path=tuple(t for _, t in path))))
        lines.clear()

    for line in text.split("\n"):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if mark and (not fence or (line.strip().startswith(fence) and not line.strip().strip(fence[0]))):
            fence = "" if fence else mark[1]
        heading = None if fence or mark else re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if heading:
            flush()
            level = len(heading[1])
            path[:] = [p for p in path if p[0] < level]
            if heading[2]:
                path.append((level, heading[2]))
        lines.append(line)
    flush(True)
    return out


def format_json(text: str) -> str:
    """Pretty-printed JSON; comments and trailing commas are allowed; else the text itself."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[\]}])', lambda m: m[1] or "", plain)
    try:
        return json.dumps(json.loads(plain), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def xml_text(text: str) -> str:
    """The text nodes, a line each; a document type or an error gives the text itself."""
    if re.search(r"<!DOCTYPE|<!ENTITY", text, re.I):
        return text
    try:
        return "\n".join(t.strip() for t in ElementTree.fromstring(text.encode()).itertext() if t.strip())
    except ElementTree.ParseError:
        return text


def mask_json(value: object, names: tuple[str, ...] = ("key", "secret", "token", "password")) -> object:
    """Values of properties whose name holds one of the names become ``***``, at any depth."""
    if isinstance(value, dict):
        return {k: "***" if any(n in k.lower() for n in names) and not isinstance(v, (dict, list)) else mask_json(v, names) for k, v in value.items()}
    return [mask_json(v, names) for v in value] if isinstance(value, list) else value


Parser = Callable[[str, bytes], list[Section]]


class Registry:
    """Parsers by extension; two may not claim the same one."""

    def __init__(self) -> None:
        self.parsers: dict[str, Parser] = {}

    def add(self, extensions: tuple[str, ...], parser: Parser) -> Registry:
        for e in extensions:
            if e in self.parsers:
                raise ValueError(f".{e} has a parser already")
            self.parsers[e] = parser
        return self

    def resolve(self, path: str) -> Parser | None:
        return self.parsers.get(path.rpartition(".")[2].lower())


def default_registry() -> Registry:
    from . import html, office, sheets

    text = lambda f: lambda path, data: [Section("prose", f(decode(data)))]
    return (
        Registry()
        .add(("txt",), lambda path, data: parse_text(decode(data)))
        .add(("log",), lambda path, data: parse_text(decode(data), True))
        .add(("md", "markdown"), lambda path, data: parse_markdown(decode(data)))
        .add(("json",), text(format_json))
        .add(("xml",), text(xml_text))
        .add(("html", "htm"), lambda path, data: html.sections(html.decode_html(data)))
        .add(("rtf",), lambda path, data: office.parse_rtf(data))
        .add(("csv",), lambda path, data: sheets.parse_csv(path, decode(data)))
        .add(("xlsx", "xlsm"), lambda path, data: sheets.parse_xlsx(path, data))
        .add(("docx",), lambda path, data: office.parse_docx(data))
        .add(("pptx",), lambda path, data: office.parse_pptx(data))
        .add(("pdf",), lambda path, data: office.parse_pdf(data))
    )


def embedded_files(path: str, data: bytes) -> list[tuple[str, bytes]]:
    """Files inside an office package."""
    import io
    import zipfile

    if path.rpartition(".")[2].lower() not in ("docx", "xlsx", "xlsm", "pptx"):
        return []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(n.rpartition("/")[2], z.read(n)) for n in z.namelist() if "/embeddings/" in n]
    except zipfile.BadZipFile:
        return []


@dataclass
class Budget:
    """Bytes that files inside a file, at all depths together, may still have."""

    left: int = MOST_EMBEDDED_BYTES

    def take(self, n: int) -> bool:
        self.left -= n
        return self.left >= 0


def gather(path: str, data: bytes, registry: Registry, depth: int = EMBEDDED_DEPTH, budget: Budget | None = None) -> list[Section]:
    """Sections of a file and of the files inside it, to a depth and a total size."""
    budget = budget or Budget()
    parser = registry.resolve(path)
    out = list(parser(path, data)) if parser else []
    if depth > 0:
        for name, inner in embedded_files(path, data):
            if not budget.take(len(inner)):
                break
            for s in gather(name, inner, registry, depth - 1, budget):
                at = s.location
                here = Location(at.page, at.slide, at.sheet, at.cell_range, at.heading_path, at.title, (name, *at.embedded_path))
                out.append(Section(s.kind, s.text, here, s.keep_whole, f"{name} › {s.table_key}" if s.table_key else None))
    return out


_SECTION = pa.struct([("kind", pa.string()), ("text", pa.string()), ("keep_whole", pa.bool_()), ("table_key", pa.string()), ("page", pa.int32()), ("slide", pa.int32()), ("sheet", pa.string()), ("cell_range", pa.string()), ("heading_path", pa.list_(pa.string())), ("title", pa.string()), ("embedded_path", pa.list_(pa.string()))])


def as_row(s: Section) -> dict:
    at = s.location
    return {"kind": s.kind, "text": s.text, "keep_whole": s.keep_whole, "table_key": s.table_key, "page": at.page, "slide": at.slide, "sheet": at.sheet, "cell_range": at.cell_range, "heading_path": list(at.heading_path), "title": at.title, "embedded_path": list(at.embedded_path)}


class ParseTimeout(BaseException):
    """A file took longer than it may; no parser's own handling of errors takes it."""


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Ends the block after some seconds; only in a process's main thread, as Spark's workers are."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise ParseTimeout

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse(files: DataFrame, *, seconds: float = PARSE_SECONDS) -> DataFrame:
    """(path, sections, error) of files (path, content): one bad file costs its own row only, and
    one that takes longer than ``seconds`` has the error timeout; a null content is a locked file."""
    from foliant.operators.chunking import SECTIONS

    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = default_registry()
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                error, sections = None, []
                try:
                    if registry.resolve(path) is None:
                        error = "unsupported"
                    elif data is None:
                        error = "locked"
                    else:
                        with time_limit(seconds):
                            sections, cut = limit(gather(path, data, registry))
                        error = "truncated" if cut else None
                except ParseTimeout:
                    error = "timeout"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[as_row(s) for s in sections]], pa.list_(_SECTION)), pa.array([error], pa.string())], names=["path", "sections", "error"])

    return files.select("path", "content").mapInArrow(run, f"path string, sections {SECTIONS}, error string")
