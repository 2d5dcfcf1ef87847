"""Fuzzy line dedup by MinHash.

A line is known by its words, A-Z lower-cased, joined by one space; lines without a word stay.
Signatures are minima of 48 permutations over 7-character shingles, cut into 12 bands of 4 rows:
a pair at Jaccard 0.8 shares a band with chance 0.998, at 0.9 with chance 1 - 2.7e-6.

Equal lines are one line from the start: hash buckets of the lines' own hashes find where each
occurs first.  Buckets of the band keys pass on only keys that two different lines share, and such
a line's text is fetched once.  Pairs under a key are verified by exact Jaccard on the shingle
sets; a crowded key is searched in tiles that emit spanning trees.  Union-find over the verified
pairs then keeps the first occurrence (doc_id, line number) of each component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ROW, ROW_ARROW, TEXT, Block, ask, blocks_of, buckets_for, cells, expand, from_planes, pack_sorted, planes, squeeze, unpack_sorted
from .components import components
from .runtime import cut, discard, free_name, release, ship
from .textcodes import U64, mix, runs, window_hashes

SHINGLE = 7
BANDS, ROWS = 12, 4
SIMILARITY = 0.8
#: Lines under a key up to which all its pairs are formed (2016 at most).
CROWD = 64
#: Lines of a tile of a crowded key.
TILE = 512
#: Characters whose hashes are permuted at once, so that they stay in a core's cache.
SLICE = 1 << 16
#: Pairs verified at once.
PAIRS = 2048
#: A-Z lower-cased, and white space other than the newline as a space.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t\x0b\x0c\r", bytes(range(97, 123)) + b"    ")
_rng = np.random.Generator(np.random.PCG64(0x11E5))
MULTIPLY = (_rng.integers(0, 1 << 31, BANDS * ROWS) * 2 + 1).astype(np.uint32)
ADD = _rng.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)


def hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the shingles of all lines, their number by line); a line shorter than a
    shingle is padded to one."""
    texts = [t.ljust(SHINGLE, "\0") for t in lines]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(length)
    valid = np.ones(len(codes), np.bool_)
    for i in range(1, SHINGLE):
        valid[end - i] = False
    # An odd multiplier spreads code points; windows are mixed at the end.
    hashes = window_hashes(codes.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1), SHINGLE)
    return hashes[valid[: len(hashes)]], length - SHINGLE + 1


def band_keys(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) keys."""
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    lo = 0
    while lo < len(lines):
        hi, size = lo, 0
        while hi < len(lines) and (hi == lo or size < SLICE):
            size += len(lines[hi])
            hi += 1
        hashes, count = hashed([x.decode() for x in lines[lo:hi]])
        hashes = (hashes >> U64(32)).astype(np.uint32)
        start = np.cumsum(count) - count
        permuted = np.empty_like(hashes)
        for r in range(BANDS * ROWS):
            np.multiply(hashes, MULTIPLY[r], out=permuted)
            permuted += ADD[r]
            np.minimum.reduceat(permuted, start, out=least[r, lo:hi])
        lo = hi
    key = np.repeat(np.arange(1, BANDS + 1, dtype=U64)[:, None], len(lines), axis=1)
    for r in range(ROWS):
        key = mix(key + least[r::ROWS])
    return key.T


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each line, sorted."""
    if not lines:
        return []
    hashes, count = hashed(lines)
    out = []
    for x in np.split(hashes, np.cumsum(count)[:-1]):
        x.sort()
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
    return out


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of :func:`shingle_sets` have that Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= similarity * (len(a) + len(b) - shared)


def spanning_tree(names: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning tree of each component of the similar sets.

    Breadth first: a reached line is compared at once with all lines not reached yet, by marking
    its shingles in a table and counting the marks of each."""
    size = np.array([len(x) for x in sets], np.int64)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    start = np.cumsum(size) - size
    rest = np.argsort(names, kind="stable")
    a: list[int] = []
    b: list[int] = []

    def gather(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[lines]
        begin = np.cumsum(n) - n
        return shingle[np.repeat(start[lines] - begin, n) + np.arange(int(n.sum()))], begin

    mark = np.zeros(int(shingle.max(initial=0)) + 1, np.bool_)
    flat, begin = gather(rest)
    alive = np.ones(len(rest), np.bool_)  # of the lines that flat holds
    while alive.any():
        first = int(np.argmax(alive))
        alive[first] = False
        frontier = [int(rest[first])]
        while frontier and alive.any():
            x = frontier.pop()
            own = shingle[start[x] : start[x] + size[x]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], begin, dtype=np.int64)
            mark[own] = False
            near = np.flatnonzero(alive & (shared >= similarity * (size[x] + size[rest] - shared)))
            a += [int(names[x])] * len(near)
            b += names[rest[near]].tolist()
            frontier += rest[near].tolist()
            alive[near] = False
            if np.count_nonzero(alive) * 2 < len(rest):
                rest = rest[alive]
                if not len(rest):
                    break
                flat, begin = gather(rest)
                alive = np.ones(len(rest), np.bool_)
        if not len(rest):
            break
    return a, b


class Lines:
    """The lines of a block; ``distinct`` has those with a word once each."""

    def __init__(self, block: Block):
        data = bytes(block.data)
        plain = data.translate(PLAIN)
        offsets = block.offsets.tolist()
        index: dict[bytes, int] = {}
        self.raw: list[list[bytes]] = []
        self.which: list[list[int]] = []
        self.first: list[tuple[int, int]] = []
        for doc_id, lo, hi in zip(block.ids.tolist(), offsets[:-1], offsets[1:], strict=True):
            which = []
            for number, line in enumerate(plain[lo : hi - 1].split(b"\n")):
                if b"  " in line or line[:1] == b" " or line[-1:] == b" ":
                    line = b" ".join(line.split())
                if not line:
                    which.append(-1)
                    continue
                i = index.setdefault(line, len(index))
                if i == len(self.first):
                    self.first.append((doc_id, number))
                elif (doc_id, number) < self.first[i]:
                    self.first[i] = (doc_id, number)
                which.append(i)
            self.raw.append(data[lo : hi - 1].split(b"\n"))
            self.which.append(which)
        self.distinct = list(index)

    def names(self) -> np.ndarray:
        """The hash by which a line is known in all blocks."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(x) for x in self.distinct), U64, len(self.distinct))


def bucket_of(name: str, n_buckets: int) -> Column:
    """The bucket in which :func:`cells` puts a hash; n_buckets is a power of two."""
    return F.shiftrightunsigned(F.col(name), 64 - (n_buckets.bit_length() - 1)).cast("int")


def _ask_names(table: DataFrame, n_buckets: int) -> DataFrame:
    """For each block and bucket, the block's lines and where each occurs first in it."""

    def requests(block: Block) -> list[tuple[int, bytes]]:
        lines = Lines(block)
        names = lines.names()
        order = np.argsort(names, kind="stable")
        names, first = names[order], np.array(lines.first, np.int64).reshape(-1, 2)[order]
        return [(b, squeeze(pack_sorted(names[s]), planes(first[s, 0].view(U64)), planes(first[s, 1].view(U64)))) for b, s in cells(names, n_buckets)]

    return ask(table, requests)


def _occurrences(group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the blocks' parts, and of all their lines: name, doc_id, number) of a bucket."""
    parts = [expand(x) for x in group.column("payload").to_pylist()]
    names = [unpack_sorted(p[0]) for p in parts]
    every = [np.concatenate(x) if x else np.zeros(0, U64) for x in (names, [from_planes(p[1], U64) for p in parts], [from_planes(p[2], U64) for p in parts])]
    return [len(x) for x in names], every[0], every[1].view(np.int64), every[2].view(np.int64)


def _first_of(names: np.ndarray, doc_id: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct names, index of the least (doc_id, number) of each)."""
    order = np.lexsort((number, doc_id, names))
    first = runs(names[order])
    return names[order[first]], order[first]


SHARED = "key long, line long, block long"


def _shared_keys(table: DataFrame, size: int) -> DataFrame:
    """(key, line, block) of band keys that two different lines have; block is one that has the line."""
    n_buckets = buckets_for(size, 0.04, 1_000_000)

    def requests(block: Block) -> list[tuple[int, bytes]]:
        lines = Lines(block)
        keys, names = band_keys(lines.distinct).ravel(), np.repeat(lines.names(), BANDS)
        order = np.argsort(keys)
        keys, names = keys[order], names[order]
        return [(b, squeeze(pack_sorted(keys[s]), names[s].tobytes())) for b, s in cells(keys, n_buckets)]

    def shared(group: pa.Table) -> pa.Table:
        parts = [expand(x) for x in group.column("payload").to_pylist()]
        sizes = [len(p[1]) // 8 for p in parts]
        keys, names = np.concatenate([unpack_sorted(p[0]) for p in parts]), np.concatenate([np.frombuffer(p[1], U64) for p in parts])
        block = np.repeat(group.column("block").to_numpy(), sizes)
        order = np.argsort(keys)
        first = runs(keys[order])
        size = np.diff(np.concatenate((first, [len(order)])))
        several = order[np.repeat(size > 1, size)]  # the rest is the most
        keys, names, block = keys[several], names[several], block[several]
        order = np.lexsort((block, names, keys))
        keys, names, block = keys[order], names[order], block[order]
        new_key = np.ones(len(keys), np.bool_)
        new_key[1:] = keys[1:] != keys[:-1]
        new = new_key.copy()
        new[1:] |= names[1:] != names[:-1]
        keys, names, block = keys[new], names[new], block[new]
        first = np.flatnonzero(new_key[new])
        size = np.diff(np.concatenate((first, [len(keys)])))
        stay = np.repeat(size > 1, size)
        out = pa.table({"key": keys[stay].view(np.int64), "line": names[stay].view(np.int64), "block": block[stay]})
        release()
        return out

    return cut(ask(table, requests).groupBy("bucket").applyInArrow(shared, SHARED), "lines-bands")


def _fetch(table: DataFrame, needed: DataFrame) -> DataFrame:
    """(line, text) of the lines that needed (line, block) names."""

    def texts(mine: pa.Table, wanted: pa.Table) -> pa.Table:
        line, text = [], []
        if wanted.num_rows:
            lines = Lines(Block(mine.column("payload")[0].as_py()))
            where = {n: i for i, n in enumerate(lines.names().view(np.int64).tolist())}
            line = wanted.column("line").to_pylist()
            text = [lines.distinct[where[n]].decode() for n in line]
        out = pa.table({"line": pa.array(line, pa.int64()), "text": pa.array(text, pa.string())})
        release()
        return out

    return table.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(texts, "line long, text string")


def _keepers(named: DataFrame, member: DataFrame, n_buckets: int) -> DataFrame:
    """(line, doc_id, number): for each line of member (node, component), where the first line of
    its component occurs first."""

    def firsts(group: pa.Table, members: pa.Table) -> pa.Table:
        line, component = (members.column(c).to_numpy().astype(np.int64) for c in ("node", "component"))
        doc_id = number = np.zeros(0, np.int64)
        if len(line):
            _, names, doc_id, number = _occurrences(group)
            mine = np.flatnonzero(np.isin(names, line.view(U64)))
            names, at = _first_of(names[mine], doc_id[mine], number[mine])
            at = mine[at][np.searchsorted(names, line.view(U64))]
            doc_id, number = doc_id[at], number[at]
        out = pa.table({"line": line, "component": component, "doc_id": doc_id, "number": number})
        release()
        return out

    members = member.withColumn("bucket", bucket_of("node", n_buckets))
    first = cut(named.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInArrow(firsts, "line long, component long, doc_id long, number long"), "lines-firsts")
    keeper = first.groupBy("component").agg(F.min(F.struct("doc_id", "number")).alias("keeper"))
    return cut(first.select("line", "component").join(keeper, "component").select("line", "keeper.doc_id", "keeper.number"), "lines-keepers")


def _answers(named: DataFrame, keepers: DataFrame, n_buckets: int) -> DataFrame:
    """For each block and bucket, the keeper of each of the block's lines, in the order of their names."""

    def answer(group: pa.Table, kept: pa.Table) -> pa.Table:
        out = []
        if group.num_rows:
            sizes, names, doc_id, number = _occurrences(group)
            distinct, at = _first_of(names, doc_id, number)
            best = np.stack((doc_id[at], number[at]))
            line = kept.column("line").to_numpy().astype(np.int64).view(U64)
            place = np.searchsorted(distinct, line)
            best[0, place], best[1, place] = kept.column("doc_id").to_numpy(), kept.column("number").to_numpy()
            place = np.searchsorted(distinct, names)
            other = (best[0, place] != doc_id) | (best[1, place] != number)
            lo = 0
            for n in sizes:  # only keepers that lie elsewhere travel
                mine = other[lo : lo + n]
                changed = place[lo : lo + n][mine]
                out.append(squeeze(np.packbits(mine).tobytes(), planes(best[0, changed].view(U64)), planes(best[1, changed].view(U64))))
                lo += n
        table = pa.Table.from_arrays([group.column("block"), group.column("bucket"), pa.array(out, pa.binary())], schema=ROW_ARROW)
        release()
        return table

    return named.groupBy("bucket").cogroup(keepers.withColumn("bucket", bucket_of("line", n_buckets)).groupBy("bucket")).applyInArrow(answer, ROW)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs under each key of rows (key, line) sorted by key."""
    rest_key, rest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(key: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        start = runs(key)
        size = np.diff(np.concatenate((start, [len(key)])))
        a, b = [], []
        for m in np.unique(size[size > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            at = start[size == m][:, None]
            a.append(line[(at + i).ravel()])
            b.append(line[(at + j).ravel()])
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        both = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0) if len(left) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        key = np.concatenate((rest_key, batch.column(0).to_numpy(zero_copy_only=False)))
        line = np.concatenate((rest, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(key):
            continue
        at = int(np.searchsorted(key, key[-1]))
        if at:
            yield pairs(key[:at], line[:at])
        rest_key, rest = key[at:], line[at:]
    if len(rest_key):
        yield pairs(rest_key, rest)


def similar_lines(bands: DataFrame, lines: DataFrame, similarity: float, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """(a, b): verified links between lines (line, text) that share a key of bands (key, line)."""
    crowded = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("line") % 1_000_000_007).alias("s"), F.bit_xor("line").alias("x")).filter(F.col("n") > crowd)
    crowded = cut(crowded.groupBy("n", "s", "x").agg(F.collect_list("key").alias("keys")), "lines-crowded")
    every = crowded.select(F.explode("keys").alias("key"))
    some = not crowded.isEmpty()
    plain = bands.join(every, "key", "left_anti") if some else bands
    pairs = plain.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_pairs, "a long, b long").distinct()
    left = lines.select(F.col("line").alias("a"), F.col("text").alias("text_a"))
    right = lines.select(F.col("line").alias("b"), F.col("text").alias("text_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAIRS):
                part = batch.slice(lo, PAIRS)
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                texts = list(dict.fromkeys(left + right))
                sets = dict(zip(texts, shingle_sets(texts), strict=True))
                good = [similar(sets[x], sets[y], similarity) for x, y in zip(left, right, strict=True)]
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))
            release()

    links = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")
    if not some:
        return links

    # Keys that hold the same lines are searched once; each pair of tiles is one group.
    once = crowded.select(F.element_at("keys", 1).alias("key"), F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    own, other = F.pmod(F.xxhash64("line"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    grouped = bands.join(once, "key").withColumn("own", own).withColumn("other", other).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "line")

    def search(group: pa.Table) -> pa.Table:
        a, b = spanning_tree(group.column("line").to_numpy(), shingle_sets(group.column("text").to_pylist()), similarity)
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dense = grouped.join(lines.select("line", "text"), "line").groupBy("cell").applyInArrow(search, "a long, b long")
    return links.unionByName(dense)


RESULTS = ("n_lines", "n_removed", "kept_sha256")


def deduplicate(docs: DataFrame, *, similarity: float = SIMILARITY, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """Keep one line of each component of similar lines.

    Input: doc_id, text and any other columns, which stay.  Result: the same columns with ``text``
    less its removed lines, then n_lines, n_removed, kept_sha256; where docs has a column of that
    name (in any case), it stays and the new one gets an underscore more.  A null text stays null
    and counts no lines, an empty one has one line without words, which stays.  Rows that repeat a
    doc_id count as one text's rows: a line they share at one number stays in each.  A null
    doc_id is the smallest.  An empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    carry = [c for c in docs.columns if c != "text"]
    results = [free_name(c, docs.columns) for c in RESULTS]
    null = free_name("null", docs.columns)
    given = docs.select(*(F.col(f"`{c}`") for c in carry), F.col("text").cast("string").alias("text"), F.col("text").isNull().alias(null))
    table, size = blocks_of(given, label="lines", carry=(*carry, null))
    n_names = buckets_for(size, 0.004, 1_000_000)
    named = cut(_ask_names(table, n_names), "lines-names")
    bands = _shared_keys(table, size)
    lines = cut(_fetch(table, bands.select("line", "block").distinct()), "lines-distinct")
    links = similar_lines(bands.select("key", "line"), lines, similarity, crowd, tile)
    member = components(links, "a", "b", "lines")
    keepers = _keepers(named, member, n_names)
    answers = _answers(named, keepers, n_names)
    discard(bands, lines)

    names = [*carry, "text", *results]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {"text": "string"} | dict(zip(results, ("bigint", "bigint", "string"), strict=True))

    def finish(group: pa.Table) -> pa.Table:
        got = dict(zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist(), strict=True))
        block = Block(got.pop(TEXT))
        found = Lines(block)
        name = found.names()
        order = np.argsort(name, kind="stable")
        keepers = list(found.first)
        for b, s in cells(name[order], n_names):
            other, doc_id, number = expand(got[b])
            mine = order[s][np.unpackbits(np.frombuffer(other, np.uint8), count=s.stop - s.start).view(np.bool_)]
            for i, d, k in zip(mine.tolist(), from_planes(doc_id, U64).view(np.int64).tolist(), from_planes(number, U64).tolist(), strict=True):
                keepers[i] = (d, k)
        carried = block.carried()
        nulls = carried.column(len(carry)).to_pylist()
        texts, n_lines, n_removed, digests = [], [], [], []
        for d, (raw, which) in enumerate(zip(found.raw, found.which, strict=True)):
            doc_id = int(block.ids[d])
            stay = [x for k, (x, i) in enumerate(zip(raw, which, strict=True)) if i < 0 or keepers[i] == (doc_id, k)]
            text = b"\n".join(stay)
            texts.append(None if nulls[d] else text.decode())
            n_lines.append(0 if nulls[d] else len(raw))
            n_removed.append(len(raw) - len(stay))
            digests.append(hashlib.sha256(text).hexdigest())
        out = [*(carried.column(i) for i in range(len(carry))), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        release()
        return pa.Table.from_arrays(out, names=names)

    rows = table.unionByName(answers).groupBy("block").applyInArrow(finish, ", ".join(f"`{n}` {types[n]}" for n in names))
    return rows.select(*(F.col(f"`{c}`") for c in (*docs.columns, *results)))
