"""Session plumbing shared by the corpus operators.

Long jobs cut their lineage by writing a table below the folder named by
``spark.checkpoint.dir`` and reading it back, so a lost executor costs a re-read and not a
re-run.  A machine-local folder serves only with a local master that has no such setting.  Shuffle files of
a written table go at once; its own files go when :func:`scratch` ends or :func:`discard` is called.
"""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.shared import shared_folder
from foliant.shipping import ship  # noqa: F401  the operators take it from here

try:
    _LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
except OSError:  # another C library: memory stays with the worker
    _LIBC = None


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/foliant/{label}-{uuid.uuid4().hex}"


#: Paths that cut has written, for the innermost :func:`scratch`.
_SCRATCH: list[list[str]] = []
#: Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    with _cleaning(df.sparkSession):
        df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that :func:`cut` wrote inside.  What leaves it must have been
    written elsewhere before, for instance by :func:`settle`."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_path(spark, path)


def settle(df: DataFrame, label: str) -> DataFrame:
    """As :func:`cut`, for a table that outlives the scratch it is made in."""
    held = _SCRATCH[:]
    _SCRATCH.clear()
    try:
        return cut(df, label)
    finally:
        _SCRATCH[:] = held


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table whose readers are done."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later plan reads."""
    for t in tables:
        for f in {x.rpartition("/")[0] for x in t.inputFiles()}:
            drop_path(t.sparkSession, f)


def release() -> None:
    """Give memory of finished work back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def spread(amount: int, each: int) -> int:
    """Number of buckets for ``amount`` units at ``each`` units a bucket: a power of two, at least 16."""
    return 1 << max(4, (-(-int(amount or 0) // each) - 1).bit_length())


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as it takes to clash with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
