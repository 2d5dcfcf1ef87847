"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again, and then what the stage wrote on its way is deleted, as is the
stage's input.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, langid, lines, sentencepiece_sa, simhash
from foliant.llm.runtime import cut, discard, scratch, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null or letterless ones, and texts that are
    like no language's prototype, such as encoded data."""
    return langid.keep_identified(docs, langid.learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays; a document that lost all its words goes, one
    that had none stays."""
    kept = lines.deduplicate(docs)
    n_removed = kept.columns[len(docs.columns) + 1]
    kept = kept.filter((F.col(n_removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates stays, with all rows
    that repeat its id; rows without an id count as one document, which stays where nothing but
    such rows is in one of its groups.

    The documents that go are joined by id, as they are fewer than those that stay."""
    keeper = F.col("doc_id").eqNullSafe(F.col("component_id"))
    go = simhash.near_duplicates(docs).groupBy("doc_id").agg(F.bool_or(keeper).alias("stays")).filter("NOT stays")
    go = cut(go.select(F.col("doc_id").alias("_go")), "pipeline-go")
    return docs.join(go, docs["doc_id"].eqNullSafe(go["_go"]), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go, of items without an id as well;
    null and empty texts stay, and all do if the benchmark is empty."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.remove(docs, items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding; a null or empty text has none."""
    return sentencepiece_sa.encode(docs).select("doc_id", "n_tokens", "ids", "ids_sha256", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

#: MinHash, SimHash components, hypervectors and piece lattices aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
