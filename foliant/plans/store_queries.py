"""Registered queries: store maintenance, sync and activity rollups over driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import activity, store, sync

from .registry import query, table


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a folder: documents before and after edits, deletions and moves."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.sha2("text", 256).alias("hash"))
    path = F.concat(F.lit("/"), "source", F.lit("/D"), F.col("doc_id").cast("string"))
    before = d.filter("doc_id % 7 <> 0").select(path.alias("path"), F.col("n_chars").alias("size_bytes"), F.lit(1).alias("mtime"), F.lit(False).alias("too_large"), F.lit(None).cast("timestamp").alias("next_retry_at"), "hash", "doc_id")
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("/moved"), path)).otherwise(F.lower(path))
    after = d.filter("doc_id % 5 <> 0").select(moved.alias("path"), (F.col("n_chars") + (F.col("doc_id") % 3 == 0).cast("int")).alias("size"), F.lit(1).alias("mtime"), F.lit(False).alias("too_large"), "hash", "doc_id")
    return before, after


_SNAP = """b AS (SELECT '/' || source || '/D' || doc_id AS path, n_chars AS size, text, doc_id, source FROM documents WHERE doc_id % 7 <> 0),
 a AS (SELECT CASE WHEN doc_id % 11 = 0 THEN '/moved/' || source || '/D' || doc_id ELSE lower('/' || source || '/D' || doc_id) END AS path, n_chars + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS size, text, doc_id FROM documents WHERE doc_id % 5 <> 0),
 r AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'missing' WHEN a.size <> b.size THEN 'changed' ELSE 'same' END AS change FROM a FULL OUTER JOIN b ON lower(a.path) = lower(b.path))"""


@query(f"WITH {_SNAP} SELECT path, change FROM r")
def sync_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return sync.reconcile(after, before)


@query(f"""WITH {_SNAP}, n AS (SELECT r.path, a.size, a.text, row_number() OVER (PARTITION BY a.size, a.text ORDER BY r.path) AS nth FROM r JOIN a ON a.path = r.path WHERE change = 'new'),
 m AS (SELECT r.path, b.size, b.text, row_number() OVER (PARTITION BY b.size, b.text ORDER BY r.path) AS nth FROM r JOIN b ON b.path = r.path WHERE change = 'missing')
 SELECT m.path AS old_path, n.path AS new_path FROM n JOIN m ON n.size = m.size AND n.text = m.text AND n.nth = m.nth""")
def sync_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    changes = sync.reconcile(after, before)
    new = after.join(changes.filter("change = 'new'"), "path").select("path", "size", "hash")
    gone = before.join(changes.filter("change = 'missing'"), "path").select("path", F.col("size_bytes").alias("size"), "hash")
    return sync.moves(new, gone)


@query(f"""WITH {_SNAP}, f AS (SELECT split_part(path, '/', 2) AS folder, change FROM r)
 SELECT folder, n_missing, n_known, n_missing >= 20 AND n_missing > n_known * 0.3 AS hold FROM (SELECT folder, sum(CASE WHEN change = 'missing' THEN 1 ELSE 0 END) AS n_missing, sum(CASE WHEN change <> 'new' THEN 1 ELSE 0 END) AS n_known FROM f GROUP BY folder)""")
def sync_mass_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return sync.mass_deletion(sync.reconcile(after, before), F.split_part("path", F.lit("/"), F.lit(2)))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, 0.0 FROM customer WHERE c_custkey % 10 = 1")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0").unionByName(c.filter("c_custkey % 10 = 1").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)).withColumn("c_acctbal", F.lit(0.0))
    return store.upsert(c, new, ["c_custkey"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY l_orderkey")
def store_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    _, kept = store.cascade(o, li, o.filter("o_orderstatus = 'F'"), "o_orderkey")
    return kept.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE NOT (source = 'src3' OR source = 'src5')")
def store_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return store.without_prefix(d, "path", spark.createDataFrame([("/DATA/src3",), ("\\data\\src5\\",)], "path string")).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '/new/' || doc_id ELSE '/old/' || doc_id END AS path FROM documents")
def store_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/old/"), F.col("doc_id").cast("string")).alias("path"))
    return store.move(d, d.filter("doc_id % 4 = 0").select(F.upper("path").alias("old_path"), F.replace("path", F.lit("old"), F.lit("new")).alias("new_path")))


@query("SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT sum(n_chars) FROM documents) AS bytes, (SELECT count(*) FROM labels) AS n_chunks, (SELECT count(*) FROM embeddings) AS n_vectors")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.statistics(table(spark, sf_dir, "documents").withColumnRenamed("n_chars", "size_bytes"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "embeddings"))


@query("SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def mode_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.mode(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("""SELECT user_id, max(CASE WHEN event_type = 'signup' THEN ts END) AS connected, max(CASE WHEN event_type = 'click' THEN ts END) AS called, max(CASE WHEN event_type = 'error' THEN ts END) AS failed,
 (SELECT props FROM events e WHERE e.user_id = events.user_id AND e.event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_error FROM events GROUP BY user_id""")
def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.summary(table(spark, sf_dir, "events"), client="user_id", kind="event_type", at="ts", id_col="event_id", kinds={"connected": "signup", "called": "click", "failed": "error"}, detail="props", error_kind="error")


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2 ORDER BY last_at DESC, event_type LIMIT 5")
def activity_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.per_minute(table(spark, sf_dir, "events"), at="ts", kind="event_type")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def activity_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.purge(table(spark, sf_dir, "events"), F.lit("2024-02-19 00:00:00").cast("timestamp"), at="ts").select("event_id")


@query("SELECT round(avg(value) * 100, 4) AS eta_s FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 20)")
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.remaining_time(table(spark, sf_dir, "events"), 100, order="event_id", column="value").select(F.round("eta_s", 4).alias("eta_s"))


@query("""SELECT folder_id, count(*) + coalesce(max(pending), 0) AS total, sum(failed) AS failed, coalesce(max(pending), 0) AS pending, count(*) - sum(failed) AS indexed FROM (SELECT source AS folder_id, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS failed FROM documents) d
 LEFT JOIN (SELECT source, count(*) AS pending FROM documents WHERE doc_id % 4 = 1 GROUP BY source) q ON q.source = folder_id GROUP BY folder_id""")
def folder_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("folder_id"), "doc_id", F.when(F.col("doc_id") % 13 == 0, "failed").otherwise("indexed").alias("status"))
    return sync.folder_statistics(d, d.filter("doc_id % 4 = 1"))


@query("""SELECT owner, count(*) AS n FROM (SELECT CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'hot' WHEN contains(lower(o_orderpriority), 'high') THEN 'warm' WHEN lower(o_orderpriority) = '5-low' THEN 'cold' ELSE 'other' END AS owner FROM orders) GROUP BY owner""")
def client_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = activity.classify(F.col("o_orderpriority"), {"5-low": "cold"}, [("urgent", "hot"), ("high", "warm")])
    return table(spark, sf_dir, "orders").groupBy(owner.alias("owner")).agg(F.count("*").alias("n"))


@query("SELECT user_id, least, median, largest FROM (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, min(value) OVER (PARTITION BY user_id) AS least, value AS median, max(value) OVER (PARTITION BY user_id) AS largest FROM events WHERE user_id = 7) WHERE r = n // 2 + 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.upper_median(table(spark, sf_dir, "events").filter("user_id = 7"), "value").select(F.lit(7).cast("long").alias("user_id"), "least", "median", "largest")
