"""Which texts hold which of many given strings, verbatim.

One pass over the text, whatever the number of strings.  Texts are read as overlapping numbers of
eight bytes.  A string of up to eight bytes is such a number; a longer one is looked up by one of its
numbers (an anchor, the one that fewest strings of the block have) and the number it ends with, and
what is left is compared as a whole.  UTF-8 can't match in the middle of a character, so bytes give
the same as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliant.shipping import ship

#: Strings, and bytes of them, that are broadcast and searched at once.
ITEMS, BLOCK_BYTES = 10_000, 4 << 20
#: Places looked at, candidates compared and rows returned at once.
SEGMENT, SPREAD, ROWS = 1 << 18, 1 << 20, 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _numbers(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end."""
    return np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))


class _Keys:
    """Sorted numbers, each with the strings that have it, behind a bitmap of their hashes."""

    def __init__(self, keys: np.ndarray, strings: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.size = np.unique(keys[order], return_index=True, return_counts=True)
        self.strings = strings[order]
        bits = max(16, len(self.keys).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, np.bool_)
        self.seen[(self.keys * _MIX) >> self.shift] = True

    def find(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, strings) in parts of a bounded size, where one key has no more strings."""
        at = np.flatnonzero(self.seen[(numbers * _MIX) >> self.shift])
        key = np.searchsorted(self.keys, numbers[at])
        key[key == len(self.keys)] = 0
        true = self.keys[key] == numbers[at]
        at, key = at[true], key[true]
        part = np.cumsum(self.size[key]) // SPREAD
        for lo, hi in zip(*(x.tolist() for x in _runs(part)), strict=True):
            size = self.size[key[lo:hi]]
            each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(at[lo:hi], size), self.strings[np.repeat(self.first[key[lo:hi]], size) + each]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of equal numbers."""
    edge = np.flatnonzero(x[1:] != x[:-1]) + 1
    return (np.concatenate(([0], edge)), np.concatenate((edge, [len(x)]))) if len(x) else (edge, edge)


class Strings:
    """Distinct strings of a block, prepared for search."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.length = np.array([len(s) for s in strings], np.int64)
        self.empty = np.flatnonzero(self.length == 0)
        #: (mask, keys) of each length up to eight.
        self.short: list[tuple[np.uint64, _Keys]] = []
        for n in range(1, 9):
            which = np.flatnonzero(self.length == n)
            if len(which):
                self.short.append((np.uint64((1 << 8 * n) - 1), _Keys(np.array([int.from_bytes(strings[i], "little") for i in which.tolist()], np.uint64), which)))
        self.offset, self.tail = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.uint64)
        which = np.flatnonzero(self.length > 8)
        self.long = self._anchors(which) if len(which) else None

    def _anchors(self, which: np.ndarray) -> _Keys:
        length = self.length[which]
        end = np.cumsum(length)
        numbers = _numbers(b"".join(self.strings[i] for i in which.tolist()))
        self.tail[which] = numbers[end - 8]
        whole = np.ones(len(numbers), np.bool_)
        for i in range(1, 8):
            whole[end - i] = False
        _, key, count = np.unique(numbers, return_inverse=True, return_counts=True)
        frequency = np.where(whole, count[key], len(numbers) + 1)
        best = np.lexsort((np.arange(len(numbers)), frequency, np.repeat(np.arange(len(which)), length)))[end - length]
        self.offset[which] = best - (end - length)
        return _Keys(numbers[best], which)

    def pairs(self, texts: list[bytes | None]) -> np.ndarray:
        """Sorted numbers text * (number of strings) + string, each pair once; null holds nothing."""
        n, data = len(self.strings), b"".join(t or b"" for t in texts)
        length = np.array([len(t or b"") for t in texts], np.int64)
        end = np.cumsum(length)
        begin, numbers = end - length, _numbers(data)
        there = np.array([t is not None for t in texts], np.bool_)
        sure, likely = [(np.flatnonzero(there)[:, None] * n + self.empty).ravel()], [np.zeros(0, np.int64)]

        def within(start: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            text = np.searchsorted(end, np.clip(start, 0, len(data) - 1), "right")
            return text, (start >= begin[text]) & (start + self.length[string] <= end[text])

        for lo in range(0, len(data), SEGMENT):
            part = np.ascontiguousarray(numbers[lo : lo + SEGMENT])
            for mask, keys in self.short:
                for at, string in keys.find(part & mask):
                    text, ok = within(at + lo, string)
                    sure.append(np.unique((text * n + string)[ok]))
            for at, string in self.long.find(part) if self.long else ():
                start = at + lo - self.offset[string]
                text, ok = within(start, string)
                start, string, text = start[ok], string[ok], text[ok]
                ok = numbers[start + self.length[string] - 8] == self.tail[string]
                likely.append(np.unique((text * n + string)[ok]))
        compared = [p for p in np.unique(np.concatenate(likely)).tolist() if self.strings[p % n] in texts[p // n]]
        return np.unique(np.concatenate((*sure, np.array(compared, np.int64))))


def holding(docs: DataFrame, items: DataFrame, size: int = ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, file): for each row of items (item_id, text), its id and that of every row of docs
    (doc_id, text) whose text holds the item's; the items are searched in blocks.

    An empty item is held by every text; null is held by none and holds none."""
    spark = docs.sparkSession
    ship(spark)
    items, docs = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")), docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    ddl = f"query_id {items.schema['item_id'].dataType.simpleString()}, file {docs.schema['doc_id'].dataType.simpleString()}"

    def scan(block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _search(batches, shared.value, id_type)

        return docs.mapInArrow(run, ddl)

    out, block, held = None, [], 0
    for name, text in items.filter("text IS NOT NULL").toLocalIterator():
        if block and (len(block) >= size or held >= block_bytes):
            found = scan(block)
            out, block, held = found if out is None else out.unionByName(found), [], 0
        block.append((name, bytes(text)))
        held += len(text)
    if block or out is None:
        found = scan(block)
        out = found if out is None else out.unionByName(found)
    return out


def _search(batches: Iterator[pa.RecordBatch], block: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    distinct: dict[bytes, list[int]] = {}
    for i, (_, text) in enumerate(block):
        distinct.setdefault(text, []).append(i)
    strings = Strings(list(distinct))
    names = pa.array([name for name, _ in block], id_type)
    rows, each = np.array([i for x in distinct.values() for i in x], np.int64), np.array([len(x) for x in distinct.values()], np.int64)
    first = np.cumsum(each) - each
    for batch in batches:
        if not len(distinct):
            continue
        pairs = strings.pairs(batch.column(1).cast(pa.binary()).to_pylist())
        text, string = pairs // len(distinct), pairs % len(distinct)
        # Rows of items with the same text are returned each.
        part = np.cumsum(each[string]) // ROWS
        for lo, hi in zip(*(x.tolist() for x in _runs(part)), strict=True):
            many = each[string[lo:hi]]
            row = rows[np.repeat(first[string[lo:hi]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), batch.column(0).take(pa.array(np.repeat(text[lo:hi], many)))], ["query_id", "file"])
