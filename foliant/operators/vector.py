"""Exact vector search and vector maintenance."""

from __future__ import annotations

import struct
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.shipping import ship


#: Queries of a block that is broadcast at once.
BLOCK_QUERIES = 1024


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if the sizes differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x / norm).cast("float")))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def of_model(vectors: DataFrame, dimensions: int, model: str | None = None, vector_col: str = "embedding") -> DataFrame:
    """Vectors of a model with the right size; others don't take part."""
    if model is not None:
        vectors = vectors.filter(F.col("model") == model)
    return vectors.filter(F.size(vector_col) == dimensions)


#: Dimensions up to which a product with a given vector is one generated expression.
NATIVE_SIZE = 128


def _unrolled(v: Column, query: list[float]) -> Column:
    """Inner product with a given vector as a balanced sum; a null component gives null."""
    terms = [F.get(v, F.lit(i)).cast("double") * F.lit(float(np.float32(x))) for i, x in enumerate(query)]
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def top_k(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the k largest inner products; equal scores by id.

    The query travels as literals, so the plan is a scan and a TakeOrderedAndProject without a
    shuffle.  Up to NATIVE_SIZE dimensions the product is one generated expression; beyond that
    scores are taken from Arrow batches as matrix products."""
    if 0 < len(query) <= NATIVE_SIZE:
        scored = vectors.filter(F.size(vector_col) == len(query)).select(id_col, _unrolled(F.col(vector_col), query).alias("score"))
        return scored.orderBy(F.desc("score"), id_col).limit(k)
    ship(vectors.sparkSession)
    q = np.asarray(query, np.float32)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            flat = np.concatenate(s.to_numpy()) if len(s) else np.zeros(0, np.float32)
            yield pd.Series(flat.reshape(len(s), len(q)).astype(np.float64) @ q.astype(np.float64))

    usable = vectors.filter(F.size(vector_col) == len(query))
    return usable.select(id_col, score(vector_col).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def best_similarity(queries: DataFrame, vectors: DataFrame, *, query_id: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, best): largest inner product of each query with any vector of its size; a query
    without one has no row, and no queries give no rows.

    Queries are packed into blocks of a fixed number by a hash, as many blocks as their count asks
    for; every block meets all vectors, one matrix product a pair of batches."""
    spark = vectors.sparkSession
    ship(spark)
    given = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    n_blocks = max(1, -(-given.count() // BLOCK_QUERIES))
    ids = f"{query_id} long, best double"
    usable = vectors.filter(F.size(vector_col) > 0).select(F.col(vector_col).cast("array<float>").alias("v"))
    out = spark.createDataFrame([], ids)
    for block in range(n_blocks):
        rows = given.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).collect()  # a block of the stated set
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r.v), []).append(r)
        shared = spark.sparkContext.broadcast({n: (np.array([r.id for r in rs], np.int64), np.array([r.v for r in rs], np.float64)) for n, rs in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {n: np.full(len(i), -np.inf) for n, (i, _) in shared.value.items()}
            for b in batches:
                column = b.column(0)
                sizes = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                for n, (_, matrix) in shared.value.items():
                    mine = starts[sizes == n]
                    if len(mine):
                        part = flat[mine[:, None] + np.arange(n)].astype(np.float64)
                        best[n] = np.maximum(best[n], (matrix @ part.T).max(axis=1))
            for n, (i, _) in shared.value.items():
                met = np.isfinite(best[n])
                yield pa.RecordBatch.from_arrays([pa.array(i[met]), pa.array(best[n][met])], names=[query_id, "best"])

        if rows:
            out = out.unionByName(usable.mapInArrow(run, ids))
    return out.groupBy(query_id).agg(F.max("best").alias("best"))


class Snapshots:
    """Persisted vectors by (model, version, dimensions), one at a time.

    While one caller loads a newer snapshot, others are served the one that is there."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.held: DataFrame | None = None
        self.gate = threading.Lock()

    def get(self, vectors: Callable[[], DataFrame], dimensions: int, version: object, model: str | None = None) -> DataFrame:
        key, (held_key, held) = (model, version, dimensions), (self.key, self.held)
        if held is not None and held_key == key:
            return held
        stale = held is not None and held_key[0] == model and held_key[2] == dimensions
        if not self.gate.acquire(blocking=not stale):
            return held
        try:
            if self.key != key:
                fresh, old = of_model(vectors(), dimensions, model).persist(), self.held
                fresh.count()
                self.held, self.key = fresh, key
                if old is not None:
                    old.unpersist()
            return self.held
        finally:
            self.gate.release()


def missing_vectors(chunks: DataFrame, vectors: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Chunks without a vector: what a backfill has to embed."""
    return chunks.join(vectors.select(chunk_id), chunk_id, "left_anti")


def save_vectors(store: DataFrame, new: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors after an upsert by (chunk_id, model) that skips vanished chunks."""
    alive = new.join(chunks.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id", "model"])
    return store.join(alive.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti").unionByName(alive)


def to_blob(vector: list[float]) -> bytes:
    return struct.pack(f"<{len(vector)}f", *vector)


def from_blob(data: bytes) -> list[float]:
    if len(data) % 4:
        raise ValueError("a vector blob holds whole 32-bit numbers")
    return list(struct.unpack(f"<{len(data) // 4}f", data))
