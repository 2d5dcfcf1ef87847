"""Structured Streaming over activity events and folder changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.shared import shared_folder


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of parquet files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    folder, _, name = path.rpartition("/")
    one = name.endswith(".parquet") and not _is_folder(spark, path)
    stream = reader.option("pathGlobFilter", name).parquet(folder) if one else reader.parquet(path)
    # Event time needs an instant; zoneless times are read in the session's zone.
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def tumbling(events: DataFrame, *, at: str, kind: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.max(at).alias("last_at"))
    return w.select(F.col("w.start").alias("start"), kind, "n", "last_at")


def sliding(events: DataFrame, *, at: str, kind: str, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w"), kind).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, *, at: str, key: str, gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of changes closer than a gap: the debounce of a watched folder."""
    s = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def distinct_events(events: DataFrame, *, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that the source has now, as a table; the stream ends with it.

    Each micro-batch is written as Parquet to the shared folder under its number, so that a
    repeated batch replaces itself and no result passes through the driver.  In complete mode the
    last batch is the whole result, else all batches together are."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    written: dict[int, str] = {}

    def write(rows: DataFrame, number: int) -> None:
        written[number] = f"{root}/rows/{number}"
        rows.write.mode("overwrite").parquet(written[number])

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    paths = [written[n] for n in sorted(written)]
    if not paths:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(paths[-1:] if mode == "complete" else paths))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Hand each micro-batch to the store; with the batch id a handler can skip a repeated one."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
