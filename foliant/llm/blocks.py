"""Blocks of documents and the packed exchange between blocks and hash buckets.

Several operators need, for each of billions of keys that occur in documents, something that
depends on all occurrences of the key.  Here every block of documents (some megabytes of text)
first removes repeats within itself, then sends for each bucket of the key space one row with
its sorted keys; the bucket merges the rows of all blocks and answers each block with values in
the order of its keys, so keys never travel back.  A key that a third of all rows hold costs a
block one entry, hence no bucket is larger than blocks times distinct keys, whatever the skew.
Keys are uniform 64-bit hashes, so buckets are even.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, release, ship, spread
from .textcodes import U64, join_texts, runs

BLOCK_BYTES = 4 << 20
ROW = "block long, bucket int, payload binary"
ROW_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
#: Bucket numbers below zero mark rows that carry a block itself.
TEXT = -1
#: Stands for a null identifier inside blocks.
NULL_ID = -(1 << 63)


def squeeze(*parts: bytes) -> bytes:
    """Length-prefixed parts under one zstd frame."""
    head = struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def expand(data: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    (n,) = struct.unpack_from("<q", raw, 0)
    sizes = struct.unpack_from(f"<{n}q", raw, 8)
    at, out = 8 * (n + 1), []
    for s in sizes:
        out.append(raw[at : at + s])
        at += s
    return out


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, which compresses well."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""


def from_planes(data: memoryview, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: memoryview) -> np.ndarray:
    return np.cumsum(from_planes(data, U64), dtype=U64)


class Block:
    """Identifiers, texts in one buffer, and offsets."""

    def __init__(self, payload: bytes):
        ids, sizes, self.data, self._carry = expand(payload)
        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64))))
        self.buf = np.frombuffer(self.data, np.uint8)

    def __len__(self) -> int:
        return len(self.ids)

    def carried(self) -> pa.Table | None:
        """The other columns of the block's rows."""
        return pa.ipc.open_stream(pa.py_buffer(self._carry)).read_all() if len(self._carry) else None


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    base, seq = (context.partitionId() if context else 0) << 32, 0
    ids: list[int] = []
    texts: list[bytes | None] = []
    rest: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, ids, texts, rest, size
        buf, offsets = join_texts(texts)
        carry = b""
        if rest:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as out:
                for r in rest:
                    out.write_batch(r)
            carry = sink.getvalue().to_pybytes()
        payload = squeeze(np.array(ids, np.int64).tobytes(), np.diff(offsets).tobytes(), buf.tobytes(), carry)
        row = pa.RecordBatch.from_pydict({"block": [base + seq], "bucket": [TEXT], "payload": [payload], "n_bytes": [len(buf)]}, schema=PACKED)
        seq, ids, texts, rest, size = seq + 1, [], [], [], 0
        release()
        return row

    for batch in batches:
        others = batch.select(range(2, batch.num_columns))
        last = 0
        for at, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True), 1):
            ids.append(i)
            texts.append(t)
            size += len(t or b"") + 1
            if size >= BLOCK_BYTES or at == batch.num_rows:
                if others.num_columns:
                    rest.append(others.slice(last, at - last))
                last = at
            if size >= BLOCK_BYTES:
                yield flush()
    if ids:
        yield flush()


PACKED = pa.schema([*ROW_ARROW, ("n_bytes", pa.int64())])


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "blocks", carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(table of blocks in the shared folder, bytes of text in it); the columns of ``carry`` stay
    with their rows."""
    ship(docs.sparkSession)
    table = cut(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carry{i}") for i, c in enumerate(carry))).mapInArrow(_pack, f"{ROW}, n_bytes long"), label)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    return table.select("block", "bucket", "payload"), total


def with_null_id(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result with its null identifiers as they were."""
    return df.withColumn(id_col, F.when(F.col(id_col) != NULL_ID, F.col(id_col)))


def buckets_for(total_bytes: int, keys_per_byte: float, keys_each: int = 1_500_000) -> int:
    return spread(int(total_bytes * keys_per_byte), keys_each)


def cells(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted keys that fall in each occupied bucket of the hash space."""
    bucket = keys // U64(-(-(1 << 64) // n_buckets)) if n_buckets > 1 else np.zeros(len(keys), U64)
    first = runs(bucket)
    for b, lo, hi in zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=False):
        yield b, slice(lo, hi)


def rows(block: int, out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], schema=ROW_ARROW)


def ask(table: DataFrame, requests: Callable[[Block], list[tuple[int, bytes]]]) -> DataFrame:
    """One row for each block and bucket with the block's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                out = rows(block, requests(Block(payload.as_py())))
                release()
                yield out

    return table.mapInArrow(run, ROW)


def answer(asked: DataFrame, merge: Callable[[list[bytes]], tuple[list[bytes], int, int]]) -> DataFrame:
    """For each bucket, the answers to all blocks; merge sees the blocks in ascending order and
    also gives two totals of the bucket, kept as total_a and total_b beside its first row."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        out, a, b = merge(group.column("payload").to_pylist())
        release()
        rest = [0] * (len(out) - 1)
        return pa.Table.from_arrays(
            [group.column("block"), group.column("bucket"), pa.array(out, pa.binary()), pa.array([a, *rest], pa.int64()), pa.array([b, *rest], pa.int64())],
            schema=pa.schema([*ROW_ARROW, ("total_a", pa.int64()), ("total_b", pa.int64())]),
        )

    return asked.groupBy("bucket").applyInArrow(run, f"{ROW}, total_a long, total_b long")


def meet(table: DataFrame, answers: DataFrame, finish: Callable[[Block, dict[int, bytes], int], pa.Table], schema: str) -> DataFrame:
    """Each block with its answers by bucket."""

    def run(group: pa.Table) -> pa.Table:
        got = dict(zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist(), strict=True))
        out = finish(Block(got.pop(TEXT)), got, group.column("block")[0].as_py())
        release()
        return out

    return table.unionByName(answers.select("block", "bucket", "payload")).groupBy("block").applyInArrow(run, schema)


def merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts all keys, run number of each sorted key, starts of the runs)."""
    every = np.concatenate(keys) if keys else np.zeros(0, U64)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = runs(every)
    number = np.zeros(len(every), np.int64)
    number[first[1:]] = 1
    return order, np.cumsum(number), first


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(data: bytes | memoryview, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).view(np.bool_)
