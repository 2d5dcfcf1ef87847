"""SimHash near-duplicates through pigeonhole blocks.

A 64-bit fingerprint is split into p parts.  Two that differ in at most k bits agree on at least
p-k whole parts, so each pair shares the key of some choice of p-k parts; p grows with the number
of fingerprints so that a key has few strangers.  Fingerprints with equal keys lie together after
a sort; inside a key a breadth-first search over the fingerprints not yet reached finds the exact
components and emits a spanning tree, never all pairs.  A key with more fingerprints than a task
should hold is cut into tiles, and each pair of tiles is searched: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, release, ship
from .textcodes import IS_SPACE, TO_LOWER, join_texts, owner, word_spans

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Strangers expected under a key.
CROWD = 16
#: Fingerprints of a tile.
TILE = 4096
#: Bytes of text handled at once.
CHUNK = 1 << 20


def _fingerprints(texts: list[bytes | None], width: int) -> list[int]:
    """Signed 64-bit fingerprints."""
    buf, offsets = join_texts(texts)
    buf = TO_LOWER[buf]
    starts, ends = word_spans(buf)
    doc = owner(offsets, starts)
    # The words with one space after each, so that a shingle is a slice.
    inside = ~IS_SPACE[buf]
    inside[ends] = True
    flat = buf[inside]
    flat[IS_SPACE[flat]] = 32
    data = flat.tobytes()
    stop = np.cumsum(ends - starts + 1) - 1
    start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    per_doc = np.bincount(doc, minlength=len(texts))
    end = np.cumsum(per_doc)
    first = end - per_doc
    at = np.arange(len(starts))
    last = np.minimum(at + width, end[doc]) - 1
    whole = (at + width <= end[doc]) | (at == first[doc])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(data[s:e], SEED) for s, e in zip(start[whole].tolist(), stop[last[whole]].tolist(), strict=True)], np.uint64, int(whole.sum()))
    shingles = np.bincount(doc[whole], minlength=len(texts))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        begin = np.cumsum(shingles)[full] - shingles[full]
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), begin)
            out[full] |= (2 * ones > shingles[full].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): shingles of ``width`` lower-cased words, repeats included; a shorter text is
    one shingle; one without words, empty or null has fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            got, lo, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or b"")
                if size >= CHUNK or i == len(texts) - 1:
                    got += _fingerprints(texts[lo : i + 1], width)
                    lo, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([ids, pa.array(got, pa.int64())], names=["doc_id", "fp"])
            release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def parts_for(n: int, distance: int = DISTANCE, crowd: int = CROWD) -> int:
    """The fewest parts at which a key of the shared parts has about ``crowd`` strangers at most."""
    p = distance + 1
    while p < 12 and n / 2 ** (64 * (p - distance) // p) > crowd:
        p += 1
    return p


def block_keys(fps: DataFrame, parts: int, distance: int = DISTANCE) -> DataFrame:
    """(key, fp): a row for each choice of parts - distance parts."""
    edges = [64 * i // parts for i in range(parts + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(parts), parts - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def tree(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning tree of each component of distinct fingerprints within the distance."""
    a: list[int] = []
    b: list[int] = []
    left = np.sort(fps)
    while len(left) > 1:
        frontier = [left[0]]
        left = left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                a += [int(x)] * len(found)
                b += found.tolist()
                frontier += list(found)
                left = left[~near]
    return a, b


def _search(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key; the last key of a batch waits for the next."""
    rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        size = np.diff(np.concatenate((start, [len(key)])))
        two = start[size == 2]
        near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= distance]
        a, b = [fp[near]], [fp[near + 1]]
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = tree(np.unique(fp[s : s + m]).view(np.uint64), distance)
            a.append(np.array(x, np.uint64).view(np.int64))
            b.append(np.array(y, np.uint64).view(np.int64))
        left, right = np.concatenate(a), np.concatenate(b)
        keep = left != right
        return pa.RecordBatch.from_arrays([pa.array(left[keep]), pa.array(right[keep])], names=["a", "b"])

    for batch in batches:
        key = np.concatenate((rest_key, batch.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((rest_fp, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(key):
            continue
        cut_at = int(np.searchsorted(key, key[-1], "left"))
        rest_key, rest_fp = key[cut_at:], fp[cut_at:]
        if cut_at:
            yield edges(key[:cut_at], fp[:cut_at])
    if len(rest_key):
        yield edges(rest_key, rest_fp)


def links(fps: DataFrame, n: int, *, distance: int = DISTANCE, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of the n distinct ``fp`` within the
    distance."""
    keyed = block_keys(fps, parts or parts_for(n, distance), distance)
    crowded = cut(keyed.groupBy("key").count().filter(F.col("count") > tile), "simhash-crowded")
    if crowded.isEmpty():
        searched = keyed
    else:
        tiles = F.ceil(F.col("count") / F.lit(tile)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        cells = (
            keyed.join(crowded.withColumn("tiles", tiles), "key").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        )
        searched = keyed.join(crowded, "key", "left_anti").unionByName(cells)
    return searched.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _search(it, distance), "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = SHINGLE, distance: int = DISTANCE, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Input: doc_id, text and any other columns.  Result for each row: doc_id, fingerprint (16
    hex digits), component_id (the smallest doc_id reachable over fingerprints that differ in at
    most ``distance`` bits).  Repeated rows share a component; a null doc_id is never the
    smallest unless no other is there.  An empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    own = cut(fingerprints(docs, width), "simhash-fp")
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    edges = links(classes.select("fp"), classes.count(), distance=distance, tile=tile, parts=parts)
    member = components(edges, "a", "b", "simhash")
    # fingerprints -> component of fingerprints -> its smallest doc_id
    joined = cut(classes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-member")
    least = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    named = cut(joined.join(least, "component").select("fp", "component_id"), "simhash-named")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
