"""The store's table maintenance as DataFrame algebra.

Tables are parquet below a root; a write goes to a new version folder and a one-row pointer names
the version that readers use, so that readers never see half a change."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those with equal keys."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys aren't there yet are added."""
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti").dropDuplicates(keys))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the rows of the keys that go."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(key), key, "left_anti")


def replace_documents(store: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks after the documents in ``chunks`` are replaced as wholes."""
    return store.join(chunks.select(key).distinct(), key, "left_anti").unionByName(chunks)


def mark(documents: DataFrame, chunks: DataFrame, marks: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after a change of status.

    marks: key, status, error, next_retry_at, keep_chunks.  The marked documents take these values;
    where chunks aren't kept they go and the document's chunk_count is 0.  Marks of unknown
    documents do nothing; of several for one document the last status by name counts."""
    once = marks.groupBy(key).agg(F.max_by(F.struct("status", "error", "next_retry_at", "keep_chunks"), "status").alias("_mark"))
    marked, drop = F.col("_mark").isNotNull(), F.col("_mark.keep_chunks").eqNullSafe(False)
    new = {c: F.when(marked, F.col(f"_mark.{c}")).otherwise(F.col(c)) for c in ("status", "error", "next_retry_at")}
    out = documents.join(once, key, "left").withColumns(new | {"chunk_count": F.when(drop, 0).otherwise(F.col("chunk_count")).cast("int")})
    gone = once.filter(drop).select(key)
    return out.select(*documents.columns), chunks.join(gone, key, "left_anti")


def without_prefix(df: DataFrame, path_col: str, prefixes: DataFrame, prefix_col: str = "path") -> DataFrame:
    """Rows whose path isn't a prefix in a small table or below one.

    Each path meets its own ancestors: they are exploded and joined by equality, which needs no
    nested loop."""
    parts = F.split(F.lower(F.replace(path_col, F.lit("\\"), F.lit("/"))), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    clean = prefixes.select(F.rtrim(F.lower(F.replace(prefix_col, F.lit("\\"), F.lit("/"))), F.lit("/")).alias("_up")).distinct()
    gone = df.select(F.col(path_col).alias("_gone"), F.explode(ancestors).alias("_up")).join(clean, "_up", "left_semi").select("_gone").distinct()
    return df.join(gone, F.col(path_col) == F.col("_gone"), "left_anti")


def move(documents: DataFrame, moves: DataFrame, path_col: str = "path") -> DataFrame:
    """Documents at their new paths (moves: old_path, new_path); who is there already goes."""
    low = F.lower(F.col(path_col))
    displaced = moves.select(F.lower("new_path").alias("_p"))
    moved = moves.select(F.lower("old_path").alias("_p"), "new_path")
    stay = documents.withColumn("_p", low).join(displaced.join(moved.select("_p"), "_p", "left_anti"), "_p", "left_anti")
    return stay.join(moved, "_p", "left").withColumn(path_col, F.coalesce("new_path", path_col)).drop("_p", "new_path")


def statistics(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts over the three tables."""
    one = documents.agg(F.count("*").alias("n_documents"), F.sum("size_bytes").alias("bytes"))
    return one.join(chunks.agg(F.count("*").alias("n_chunks"))).join(vectors.agg(F.count("*").alias("n_vectors")))


class VersionedTable:
    """A parquet table whose versions are whole folders and whose pointer is a small JSON file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        p, fs = self._fs(f"{self.root}/current.json")
        if not fs.exists(p):
            return {"version": 0, "path": None}
        return json.loads(self.spark.read.text(f"{self.root}/current.json", wholetext=True).first()[0])

    def version(self) -> int:
        return self.pointer()["version"]

    def read(self) -> DataFrame | None:
        path = self.pointer()["path"]
        return self.spark.read.parquet(path) if path else None

    def write(self, df: DataFrame, *partition_by: str) -> int:
        """Write a whole version, then turn the pointer; the old version stays for its readers."""
        now = self.pointer()
        path = f"{self.root}/v{now['version'] + 1}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy(*partition_by).parquet(path)
        text = json.dumps({"version": now["version"] + 1, "path": path})
        tmp, fs = self._fs(f"{self.root}/next-{uuid.uuid4().hex[:8]}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._fs(f"{self.root}/current.json")
        # One step that replaces the old pointer, so that readers always find one.
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(final), options)
        return now["version"] + 1

    def clear(self, like: DataFrame) -> int:
        return self.write(like.limit(0))
