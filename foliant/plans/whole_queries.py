"""Registered queries over whole tables, beside those of the same names without ``_all``, whose
given SQL holds on to one source, user, key range or name prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import activity

from .registry import query, table
from .table_queries import prefix_pairs


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_property_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, 'user=' || user_id || ' token=***' AS line FROM events")
def mask_secrets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" token=abc"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", tx.mask_secrets(line).alias("line"))


@query("""SELECT user_id, least, median, largest FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, min(value) OVER (PARTITION BY user_id) AS least, value AS median, max(value) OVER (PARTITION BY user_id) AS largest
 FROM events WHERE value IS NOT NULL) WHERE r = n // 2 + 1""")
def upper_median_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every user with a value."""
    return activity.upper_median(table(spark, sf_dir, "events").filter("value IS NOT NULL").groupBy("user_id"), "value")


@query("SELECT doc_id, length_grapheme(text) AS graphemes FROM documents")
def grapheme_lengths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.grapheme_length(F.col("text")).alias("graphemes"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def collapse_space_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.collapse_space(F.col("text")).alias("flat"))


@query("SELECT s_suppkey, lower(s_name) AS low, substr(s_name, 1, 4) AS head, s_name || '|' AS tail, length(s_name) AS n, CAST(s_suppkey AS VARCHAR) AS key_text, coalesce(CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END, 0.0) AS balance FROM supplier")
def scalar_functions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lower("s_name").alias("low"), F.substring("s_name", 1, 4).alias("head"), F.concat("s_name", F.lit("|")).alias("tail"), F.length("s_name").alias("n"), F.col("s_suppkey").cast("string").alias("key_text"),
        F.coalesce(F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")), F.lit(0.0)).alias("balance"),
    )


@query("SELECT n_nationkey FROM nation UNION SELECT s_nationkey FROM supplier EXCEPT SELECT r_regionkey FROM region")
def set_operations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "region")
    return n.select("n_nationkey").union(s.select("s_nationkey")).distinct().exceptAll(r.select("r_regionkey")).distinct()


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON starts_with(lower(p_brand) || p_partkey, lower(p_brand) || s_suppkey)")
def prefix_theta_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_pairs(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"))
