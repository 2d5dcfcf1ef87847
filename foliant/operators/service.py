"""The three calls of the engine: search, describe a table, query a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import hybrid, tables

DEFAULT_HITS, MOST_HITS, DEFAULT_ROWS = 8, 20, 100


@dataclass
class Service:
    """chunks: id, text and path columns; registered: table id to (stamp, loader of display cells)."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    registered: dict[str, tuple[object, Callable[[], DataFrame]]] = field(default_factory=dict)
    id_col: str = "doc_id"
    path_col: str = "source"
    cache: tables.TableCache = field(default_factory=tables.TableCache)

    def search(self, query: str, top_k: int = DEFAULT_HITS, prefixes: list[str] | None = None) -> DataFrame:
        """A model that fails leaves keyword search, marked as degraded."""
        vector = None
        if self.vectors is not None and self.embed is not None and query.strip():
            try:
                vector = self.embed(query)
            except Exception:
                vector = None
        return hybrid.search(self.chunks, query, max(1, min(top_k, MOST_HITS)), vectors=self.vectors, query_vector=vector, prefixes=prefixes, id_col=self.id_col, path_col=self.path_col)

    def _table(self, table_id: str) -> tuple[object, Callable[[], DataFrame]]:
        if table_id not in self.registered:
            raise tables.TableQueryError("unknown", f"there is no table {table_id}")
        return self.registered[table_id]

    def describe_table(self, table_id: str, sample_rows: int = 5) -> tables.Description:
        return tables.describe(tables.loading(table_id, self._table(table_id)[1]), sample_rows)

    def query_table(self, table_id: str, sql: str, max_rows: int = DEFAULT_ROWS) -> tables.QueryResult:
        tables.guard(sql)
        stamp, load = self._table(table_id)
        return tables.query(self.cache.get(table_id, stamp, lambda: tables.loading(table_id, load)), sql, max_rows)
