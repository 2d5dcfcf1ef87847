"""Benchmark decontamination with suffix arrays of the training text.

Each shard of training text (about a megabyte of words of consecutive rows) gets a suffix array
over word codes.  Codes are places in the sorted vocabulary of the benchmark, so a suffix that
starts with fewer known words than the shortest window can't match and isn't indexed; this drops
no match.  Suffixes are ordered by their first words packed in two 63-bit numbers.  Every test suffix
is looked up by binary search, which gives all places where its window occurs; places on one
diagonal are joined to the longest verbatim matches.

The benchmark goes to the executors in pieces of a checked size; with more than one piece, hits
are united per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, release, ship
from .suffixes import lookup, order_of, pack, spread_ranges
from .textcodes import join_texts, owner, span_hashes

WINDOW = 10
#: Bytes of benchmark text broadcast at once.
PIECE_BYTES = 16 << 20
CHUNK = 4 << 20

#: Bytes that separate words: all below 0x80 but 0-9, A-Z and a-z.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[48:58] = np.arange(48, 58)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); words are runs outside the ASCII
    characters other than letters and digits, with A-Z lower-cased."""
    buf, offsets = join_texts(texts)
    buf = FOLD[buf]
    space = buf == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    return span_hashes(buf, starts, ends), np.bincount(owner(offsets, starts), minlength=len(texts))


class TestSuffixes:
    """The suffixes of a piece of the benchmark that start a window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.window = window
        self.names = [i for i, _ in items]
        codes, count = words([t for _, t in items])
        self.vocabulary, code = np.unique(codes, return_inverse=True)
        code = code + 1
        end = np.cumsum(count)
        item = np.repeat(np.arange(len(items)), count)
        at = np.arange(len(code))
        length = np.minimum(window, count[item])
        starts = (at + length <= end[item]) & (length > 0) & ((length == window) | (at == (end - count)[item]))
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.start, self.item, self.length = at[starts], item[starts], length[starts]
        self.position = self.start - (end - count)[self.item]
        self.shortest = int(self.length.min()) if len(self.length) else 0
        self.depth = int(self.length.max()) if len(self.length) else 0
        keys = pack(np.concatenate((code, np.zeros(window, np.int64))), self.start, self.length, self.bits, self.depth)
        # Suffixes of equal windows are looked up once.
        order = np.lexsort([*reversed(keys), self.length])
        same = np.ones(len(order), np.bool_)
        for k in (*keys, self.length):
            same[1:] &= k[order][1:] == k[order][:-1]
        same[:1] = False
        self.order = order
        self.group = np.cumsum(~same) - 1
        self.first = np.flatnonzero(~same)
        self.keys = [k[order][self.first] for k in keys]
        self.lengths = self.length[order][self.first]


def search(codes: np.ndarray, count: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(places, test suffixes): each occurrence of a window in the texts of a shard."""
    none = np.zeros(0, np.int64)
    if not len(codes) or not len(test.start):
        return none, none
    place = np.searchsorted(test.vocabulary, codes)
    place[place == len(test.vocabulary)] = 0
    code = np.where(test.vocabulary[place] == codes, place + 1, 0)
    n = len(code)
    end = np.repeat(np.cumsum(count), count)
    at = np.arange(n)
    # How many known words of the same text follow each place.
    stop = np.where(code == 0, at, n)
    known = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], end) - at
    suffix = np.flatnonzero(known >= test.shortest)
    if not len(suffix):
        return none, none
    keys = pack(np.concatenate((code, np.zeros(test.window, code.dtype))), suffix, known[suffix], test.bits, test.depth)
    array = order_of(keys)
    suffix = suffix[array]
    keys = [k[array] for k in keys]
    which, places = spread_ranges(*lookup(keys, test.keys, test.lengths, test.bits))
    return suffix[places], which


HITS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("at_word", pa.int64())])
HITS_DDL = "doc_id long, row long, n_words long, hit binary, items array<string>, longest long, at_word long"


def _hits(ids: list, numbers: list[int], texts: list[bytes | None], test: TestSuffixes) -> pa.RecordBatch:
    codes, count = words(texts)
    place, group = search(codes, count, test)
    n = len(codes)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + test.lengths[group], -1)
    hit = np.cumsum(cover[:n]) > 0
    end = np.cumsum(count)
    first = end - count
    doc = np.searchsorted(end, place, "right")
    longest, at_word = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
    items: list[list[str]] = [[] for _ in texts]
    if len(place):
        # Every test suffix with the window, so that matches extend along diagonals.
        size = np.diff(np.concatenate((test.first, [len(test.order)])))
        each = size[group]
        which = test.order[np.repeat(test.first[group], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        p, d = np.repeat(place, each), np.repeat(doc, each)
        item = test.item[which]
        pairs = np.unique(d * len(test.names) + item)
        for x in pairs.tolist():
            items[x // len(test.names)].append(test.names[x % len(test.names)])
        diagonal = p - test.position[which]
        order = np.lexsort((p, diagonal, item, d))
        p, d, item, diagonal, length = p[order], d[order], item[order], diagonal[order], test.length[which][order]
        fresh = np.ones(len(p), np.bool_)
        fresh[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1] + 1)
        begin = np.flatnonzero(fresh)
        last = np.concatenate((begin[1:], [len(p)])) - 1
        reach = p[last] + length[last] - p[begin]
        by = np.lexsort((p[begin], -reach, d[begin]))
        lead = by[np.concatenate(([True], d[begin][by][1:] != d[begin][by][:-1]))]
        longest[d[begin][lead]] = reach[lead]
        at_word[d[begin][lead]] = (p[begin] - first[d[begin]])[lead]
    packed = [np.packbits(hit[s:e]).tobytes() for s, e in zip(first.tolist(), end.tolist(), strict=True)]
    return pa.RecordBatch.from_pydict({"doc_id": ids, "row": numbers, "n_words": count, "hit": packed, "items": items, "longest": longest, "at_word": at_word}, schema=HITS)


def _pieces(benchmark: DataFrame, piece_bytes: int) -> list[list[tuple[str, bytes | None]]]:
    """The stated test set in pieces of a checked size (a piece holds one item at least)."""
    pieces: list[list[tuple[str, bytes | None]]] = []
    size = piece_bytes
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary"))
    for name, text in items.orderBy("item_id", "text").toLocalIterator():
        size += len(text or b"")
        if size >= piece_bytes:
            pieces.append([])
            size = 0
        pieces[-1].append((name, bytes(text) if text is not None else None))
    return pieces


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in each text.

    A window is ``window`` consecutive words of an item; a shorter item that has words is one
    window.  Result for each row of docs (doc_id, text and any other columns): doc_id, n_words,
    n_hit (words inside an occurrence), n_items, items_sha256 (of the item_ids, sorted as
    strings, comma-joined), contaminated, longest_match (words) and match_at (its first word, or
    -1).  Null and empty texts have no words; an empty benchmark hits nothing; items with a null
    item_id are left out; repeated items count once."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    pieces = _pieces(benchmark, piece_bytes) or [[]]
    if len(pieces) > 1:
        source = cut(source, "decontam")  # so that row means the same for each piece

    def scan(piece: list[tuple[str, bytes | None]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(piece)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = TestSuffixes(shared.value, window)
            for batch in batches:
                ids, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                lo = size = 0
                for i, t in enumerate(texts):
                    size += len(t or b"")
                    if size >= CHUNK or i == len(texts) - 1:
                        yield _hits(ids[lo : i + 1], numbers[lo : i + 1], texts[lo : i + 1], test)
                        release()
                        lo, size = i + 1, 0

        return source.mapInArrow(run, HITS_DDL)

    found = scan(pieces[0])
    for piece in pieces[1:]:
        found = found.unionByName(scan(piece))
    if len(pieces) > 1:
        best = F.max(F.struct("longest", (-F.col("at_word")).alias("before")))
        found = (
            found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best.alias("best"))
            .select("doc_id", "row", "n_words", "hits", "items", F.col("best.longest").alias("longest"), (-F.col("best.before")).alias("at_word"))
        )
    else:
        found = found.withColumn("hits", F.array("hit"))
    return found.mapInArrow(_finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_at long")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["hits", "items", "n_words"]).to_pylist()
        n_hit, names = [], []
        for r in rows:
            every = np.zeros(-(-r["n_words"] // 8), np.uint8)
            for h in r["hits"]:
                every |= np.frombuffer(h, np.uint8)
            n_hit.append(int(np.bitwise_count(every).sum()))
            names.append(sorted(set(r["items"])))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in names], pa.int64()),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], "contaminated": [n > 0 for n in n_hit], "longest_match": batch.column("longest"), "match_at": batch.column("at_word"),
            }
        )


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of docs, all columns as they are, in which no benchmark window occurs.

    As in :func:`find`, items with a null item_id are left out.  Null and empty texts have no words
    and stay, as does every row if the benchmark has no words; repeated rows fare alike."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index("text")

    def without(source: DataFrame, piece: list[tuple[str, bytes | None]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(piece)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = TestSuffixes(shared.value, window)
            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                lo = size = 0
                for i, t in enumerate(texts):
                    size += len(t or b"")
                    if size >= CHUNK or i == len(texts) - 1:
                        codes, count = words(texts[lo : i + 1])
                        place, _ = search(codes, count, test)
                        clean = np.ones(len(count), np.bool_)
                        clean[np.searchsorted(np.cumsum(count), place, "right")] = False
                        yield batch.slice(lo, i + 1 - lo).filter(pa.array(clean))
                        release()
                        lo, size = i + 1, 0

        return source.mapInArrow(run, docs.schema)

    for piece in _pieces(benchmark, piece_bytes):
        docs = without(docs, piece)
    return docs
