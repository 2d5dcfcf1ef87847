"""Tables of display strings: inferred schemas and guarded read-only SQL on one view ``t``."""

from __future__ import annotations

import re
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.values import format_value, is_blank, is_number, parse_date, parse_number, sql_names

SAMPLE_ROWS, MOST_ROWS, TIMEOUT_S = 20, 500, 5.0
CACHED_TABLES, CACHE_S = 4, 60.0
MOST_VALUE_BYTES = 16 << 20


class TableQueryError(ValueError):
    """A refused or failed table query; ``kind`` says why."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def infer_kinds(cells: DataFrame) -> dict[str, str]:
    """number, date or text for each column, over all non-blank values in one aggregate; a column
    without any is text."""
    aggs = []
    for i, c in enumerate(cells.columns):
        v, full = F.col(f"`{c}`"), ~is_blank(F.col(f"`{c}`"))
        aggs += [F.count_if(full).alias(f"n{i}"), F.count_if(full & is_number(v)).alias(f"f{i}"), F.count_if(full & parse_date(v).isNotNull()).alias(f"d{i}")]
    row = cells.agg(*aggs).first()
    kind = lambda i: "text" if not row[f"n{i}"] else "number" if row[f"f{i}"] == row[f"n{i}"] else "date" if row[f"d{i}"] == row[f"n{i}"] else "text"
    return {c: kind(i) for i, c in enumerate(cells.columns)}


def typed(cells: DataFrame, kinds: dict[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Cells as double or string columns under safe names; blanks are null."""
    kinds = kinds or infer_kinds(cells)
    names = names or sql_names(cells.columns)
    out = []
    for c, name in zip(cells.columns, names, strict=True):
        v = F.col(f"`{c}`")
        value = {"number": parse_number(v), "date": parse_date(v), "text": v}[kinds[c]]
        out.append(F.when(~is_blank(v), value).alias(name))
    return cells.select(*out)


@dataclass
class Description:
    columns: list[tuple[str, str, str]]  # SQL name, header, type
    row_count: int
    samples: list[list[str]]


def describe(cells: DataFrame, sample_rows: int = 5) -> Description:
    kinds, names = infer_kinds(cells), sql_names(cells.columns)
    samples = typed(cells, kinds, names).limit(max(0, min(sample_rows, SAMPLE_ROWS))).collect()
    return Description([(n, c, kinds[c]) for n, c in zip(names, cells.columns, strict=True)], cells.count(), [[format_value(x) for x in r] for r in samples])


def mask_sql(sql: str) -> str:
    """The statement with comments blanked out, and literals and quoted names filled with a mark
    that is neither a word nor a space; same length."""
    out, i, n = list(sql), 0, len(sql)

    def blank(a: int, b: int, mark: str = " ") -> None:
        out[a:b] = mark * (b - a)

    while i < n:
        c = sql[i]
        if c in "'\"`[":
            end = {"[": "]"}.get(c, c)
            j = i + 1
            while True:
                j = sql.find(end, j)
                if j < 0:
                    raise TableQueryError("syntax", "a quote isn't closed")
                if end != "]" and sql[j + 1 : j + 2] == end:
                    j += 2
                    continue
                break
            blank(i, j + 1, "\x01")
            i = j + 1
        elif sql.startswith("--", i):
            j = sql.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
        elif sql.startswith("/*", i):
            j = sql.find("*/", i)
            j = n if j < 0 else j + 2
            blank(i, j)
            i = j
        else:
            i += 1
    return "".join(out)


# Words that no query may hold.
FORBIDDEN = re.compile(r"\b(attach|detach|pragma|load_extension|insert\s+(?:into|overwrite)|delete\s+from|merge\s+into)\b", re.I)
# Functions that leave the query's data, and those that make rows.
REFUSED_FUNCTIONS = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user current_catalog current_database current_schema version spark_version from_avro to_avro from_protobuf to_protobuf sleep".split()
)
CALLS = re.compile(rf"\b({'|'.join(sorted(REFUSED_FUNCTIONS))})\s*\(", re.I)
ROW_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"))
#: Nodes of a parsed query that stand for rows without a table, and parts of names that change things.
ROW_LEAVES = frozenset(("OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "Range"))
REFUSED_NODES = re.compile("Insert|Command|Script|Merge|Update|Delete|Create|Drop|Replace|Write|Cache|Set[A-Z]|Transform")


def guard(sql: str) -> str:
    """The statement without a closing semicolon, if it is one SELECT or WITH."""
    masked = mask_sql(sql or "")
    body = masked.rstrip()
    if body.endswith(";"):
        body = body[:-1]
    if not body.strip():
        raise TableQueryError("empty", "the query is empty")
    if ";" in body:
        raise TableQueryError("multiple", "only one statement is allowed")
    if not re.match(r"\s*(select|with)\b", body, re.I):
        raise TableQueryError("not_select", "only SELECT and WITH are allowed")
    if m := FORBIDDEN.search(body) or CALLS.search(body):
        raise TableQueryError("forbidden", f"{m[1]} isn't allowed")
    return sql[: len(body)]


def _items(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]


def check_plan(spark: SparkSession, sql: str, view: str = "t") -> None:
    """Refuse plans that read anything but the view and the query's own CTEs, run commands or
    scripts, or call functions that leave the query's data.

    Names are those of the parsed plan's nodes, each CTE's in force where SQL puts it, so no text
    of the statement can widen what may be read."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)

    def refuse(what: str) -> None:
        raise TableQueryError("forbidden", what)

    def expression(e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = [str(p).lower() for p in _items(e.nameParts())]
            if len(parts) != 1 or parts[0] in REFUSED_FUNCTIONS:
                refuse(f"the function {'.'.join(parts)} isn't allowed")
        if spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance(e):
            node(e.plan(), scope)
        for child in _items(e.children()):
            expression(child, scope)

    def node(p, scope: frozenset[str]) -> None:
        kind = p.getClass().getSimpleName()
        if REFUSED_NODES.search(kind):
            refuse("only queries are allowed")
        if kind == "UnresolvedWith":
            for cte in _items(p.cteRelations()):
                name = str(cte._1()).lower()
                node(cte._2(), scope | {name} if p.allowRecursion() else scope)
                scope |= {name}
            return node(p.child(), scope)
        if kind == "UnresolvedRelation":
            parts = [str(x) for x in _items(p.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in scope:
                refuse(f"only the table {view} can be read, not {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(str(x) for x in _items(p.name())).lower()
            if name not in ROW_FUNCTIONS:
                refuse(f"the function {name} isn't allowed")
        elif not p.children().size() and kind not in ROW_LEAVES:
            refuse(f"{kind} isn't allowed")
        for e in _items(p.expressions()):
            expression(e, scope)
        for child in _items(p.children()):
            node(child, scope)

    node(plan, frozenset((view,)))


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[list[str]]
    truncated: bool


def _translate(sql: str) -> str:
    """``"name"`` and ``[name]`` as back-quoted names; string literals stay."""
    out, i = [], 0
    while i < len(sql):
        c = sql[i]
        if c == "'":
            j = i + 1
            while not (sql[j] == "'" and sql[j + 1 : j + 2] != "'"):
                j += 2 if sql[j : j + 2] == "''" else 1
            out.append(sql[i : j + 1])
            i = j + 1
        elif c == '"' or (c == "[" and not re.search(r"[\w)\]]$", sql[:i].rstrip()[-1:] or "")):
            j = sql.index('"' if c == '"' else "]", i + 1)
            out.append("`" + sql[i + 1 : j].replace("`", "``") + "`")
            i = j + 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _bounded(df: DataFrame) -> DataFrame:
    """Texts and binaries above the size cap are an error before they reach the driver."""
    out = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"c{i}")
        wide = f.dataType.typeName() in ("string", "binary")
        out.append(F.when(F.octet_length(c) > MOST_VALUE_BYTES, F.raise_error(F.lit(f"a value is larger than {MOST_VALUE_BYTES} bytes"))).otherwise(c).alias(f"c{i}") if wide else c)
    return df.toDF(*(f"c{i}" for i in range(len(out)))).select(*out) if out else df


def loading(name: str, load: Callable[[], DataFrame]) -> DataFrame:
    """The cells of a registered table, or an error whose kind says what became of its file."""
    try:
        cells = load()
        empty = not cells.columns
    except TableQueryError:
        raise
    except FileNotFoundError as e:
        raise TableQueryError("missing", f"the file of {name} was moved or deleted") from e
    except LookupError as e:
        raise TableQueryError("moved", f"the content of {name} changed and its range isn't there; search again") from e
    except OSError as e:
        raise TableQueryError("locked", f"the file of {name} can't be read now; another program may use it") from e
    except AnalysisException as e:
        raise TableQueryError("missing" if "PATH_NOT_FOUND" in str(e) else "unreadable", f"the file of {name} can't be read: {str(e).splitlines()[0]}") from e
    except ValueError as e:
        raise TableQueryError("unreadable", f"the file of {name} can't be read: {e}") from e
    if empty:
        raise TableQueryError("no_columns", f"{name} has no columns")
    return cells


def query(table: DataFrame, sql: str, max_rows: int = 100, timeout_s: float = TIMEOUT_S) -> QueryResult:
    """Run one guarded query on a typed table as view ``t``.

    The view lives in a session of its own with ANSI mode off, so that division by zero is null.
    After the time limit the caller gets an error and the job is cancelled where Spark can."""
    max_rows = max(1, min(max_rows, MOST_ROWS))
    statement = _translate(guard(sql))
    session = table.sparkSession.newSession()
    session.conf.set("spark.sql.ansi.enabled", "false")
    check_plan(session, statement)
    name = f"t_{threading.get_ident()}_{time.monotonic_ns()}"
    table.createOrReplaceGlobalTempView(name)
    tag = f"query-{name}"
    box: dict[str, object] = {}

    def work() -> None:
        try:
            session.addTag(tag)
            session.table(f"global_temp.{name}").createOrReplaceTempView("t")
            df = session.sql(statement)
            box["columns"] = df.columns
            box["rows"] = _bounded(df.limit(max_rows + 1)).collect()
        except Exception as e:
            box["error"] = e

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(timeout_s)
    try:
        if thread.is_alive():
            session.interruptTag(tag)
            raise TableQueryError("timeout", f"the query took longer than {timeout_s:g} s")
        if "error" in box:
            raise TableQueryError("failed", f"{str(box['error']).splitlines()[0]} Columns: {', '.join(table.columns)}") from box["error"]
    finally:
        if not thread.is_alive():
            session.catalog.dropGlobalTempView(name)
    rows = box["rows"]
    return QueryResult(list(box["columns"]), [[format_value(x) for x in r] for r in rows[:max_rows]], len(rows) > max_rows)


@dataclass
class TableCache:
    """Typed tables by name: a few at most, for a minute, as long as their stamp stays."""

    size: int = CACHED_TABLES
    keep_s: float = CACHE_S
    clock: Callable[[], float] = time.monotonic
    _held: OrderedDict[str, tuple[object, float, DataFrame]] = field(default_factory=OrderedDict)
    _gate: threading.Lock = field(default_factory=threading.Lock)

    def get(self, key: str, stamp: object, load: Callable[[], DataFrame]) -> DataFrame:
        with self._gate:
            held = self._held.pop(key, None)
            if held and (held[0] != stamp or self.clock() - held[1] > self.keep_s):
                held[2].unpersist()
                held = None
            if held is None:
                held = (stamp, self.clock(), typed(load()).persist())
            self._held[key] = held
            while len(self._held) > self.size:
                self._held.popitem(last=False)[1][2].unpersist()
            return held[2]
