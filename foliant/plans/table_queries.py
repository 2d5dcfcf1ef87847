"""Registered queries: value parsing, schema inference and the relational surface of table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions import values
from foliant.operators import tables

from .registry import query, table


def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as display strings: currency with thousands, dates, percents and codes."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("order no"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("total ($)"),
        F.date_format("o_orderdate", "yyyy/M/d").alias("1st date"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("share"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("code"),
    )


@query("SELECT o_orderkey, round(o_totalprice, 2) AS total, CAST(o_custkey % 100 AS DOUBLE) AS share, strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' AS day FROM orders")
def number_and_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _display(spark, sf_dir)
    return d.select(F.col("order no").cast("long").alias("o_orderkey"), F.round(values.parse_number(F.col("total ($)")), 2).alias("total"), values.parse_number(F.col("share")).alias("share"), values.parse_date(F.col("1st date")).alias("day"))


@query("""SELECT * FROM (VALUES ('order no', 'order_no', 'number'), ('total ($)', 'total____', 'number'), ('1st date', 'c_1st_date', 'date'), ('share', 'share', 'number'), ('priority', 'priority', 'text'), ('code', 'code', 'text')) AS v(header, name, kind)""")
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _display(spark, sf_dir)
    kinds = tables.infer_kinds(d)
    return spark.createDataFrame([(h, n, kinds[h]) for h, n in zip(d.columns, values.sql_names(d.columns), strict=True)], "header string, name string, kind string")


@query("SELECT count(*) AS n, count(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END) AS with_priority, round(sum(round(o_totalprice, 2)), 1) AS total FROM orders")
def typed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.typed(_display(spark, sf_dir))
    return t.agg(F.count("*").alias("n"), F.count("priority").alias("with_priority"), F.round(F.sum("total____"), 1).alias("total"))


@query("SELECT o_orderpriority AS priority, CAST(count(*) AS VARCHAR) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_orderpriority ORDER BY priority")
def guarded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.query(tables.typed(_display(spark, sf_dir)), 'SELECT "priority", count(*) AS n FROM t WHERE "priority" IS NOT NULL GROUP BY 1 ORDER BY 1;', timeout_s=120)
    return spark.createDataFrame([tuple(r) for r in found.rows], "priority string, n string")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def group_by_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
 WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY c_mktsegment, n_name""")
def inner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    j = c.join(o.filter("o_orderdate >= TIMESTAMP '1995-01-01'"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(d.doc_id, e.vec_id) AS id, d.doc_id IS NOT NULL AS has_text, e.vec_id IS NOT NULL AS has_vector FROM documents d FULL OUTER JOIN embeddings e ON d.doc_id = e.vec_id + 700")
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select("vec_id")
    j = d.join(e, F.col("doc_id") == F.col("vec_id") + 700, "full_outer")
    return j.select(F.coalesce("doc_id", "vec_id").alias("id"), F.col("doc_id").isNotNull().alias("has_text"), F.col("vec_id").isNotNull().alias("has_vector"))


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON starts_with(lower(p_brand) || p_partkey, lower(p_brand) || s_suppkey)")
def prefix_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_pairs(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"))


def prefix_pairs(suppliers: DataFrame, parts: DataFrame) -> DataFrame:
    """(s_suppkey, p_partkey) where the part's brand and key start with that brand and the supplier's key.

    The brand stands before both, so a part meets the suppliers whose keys begin its own: an
    equality with each of its few prefixes."""
    key = F.col("p_partkey").cast("string")
    heads = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.substring(key, F.lit(1), i))
    p = parts.filter("p_brand IS NOT NULL AND p_partkey IS NOT NULL").select("p_partkey", F.explode(heads).alias("head"))
    s = suppliers.select("s_suppkey", F.col("s_suppkey").cast("string").alias("head"))
    return p.join(s, "head").select("s_suppkey", "p_partkey")


@query("SELECT n_nationkey FROM nation UNION SELECT s_nationkey FROM supplier WHERE s_suppkey < 50 EXCEPT SELECT r_regionkey FROM region")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "region")
    return n.select("n_nationkey").union(s.filter("s_suppkey < 50").select("s_nationkey")).distinct().exceptAll(r.select("r_regionkey")).distinct()


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_nationkey").intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@query("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT n, n * n AS square FROM r")
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT n, n * n AS square FROM r")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
 lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders""")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(table(spark, sf_dir, "orders"))


def _windows(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(
        "o_custkey", "o_orderkey", F.row_number().over(w).alias("nth"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("previous")
    )


@query("SELECT count(*) AS n_orders, (SELECT count(*) FROM customer) AS n_customers, (SELECT sum(length(p_name)) FROM part) AS name_chars, round(max(o_totalprice), 2) AS largest FROM orders")
def scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    one = o.agg(F.count("*").alias("n_orders"), F.round(F.max("o_totalprice"), 2).alias("largest"))
    return one.join(c.agg(F.count("*").alias("n_customers"))).join(p.agg(F.sum(F.length("p_name")).alias("name_chars")))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT s_suppkey, lower(s_name) AS low, substr(s_name, 1, 4) AS head, s_name || '|' AS tail, length(s_name) AS n, CAST(s_suppkey AS VARCHAR) AS key_text, coalesce(CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END, 0.0) AS balance FROM supplier WHERE s_name LIKE 'Supplier#0000000%' ESCAPE '!'")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter(F.col("s_name").like("Supplier#0000000%"))
    return s.select(
        "s_suppkey", F.lower("s_name").alias("low"), F.substring("s_name", 1, 4).alias("head"), F.concat("s_name", F.lit("|")).alias("tail"), F.length("s_name").alias("n"), F.col("s_suppkey").cast("string").alias("key_text"),
        F.coalesce(F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")), F.lit(0.0)).alias("balance"),
    )


@query("SELECT doc_id, length(text) AS graphemes FROM documents WHERE source = 'src2'")
def grapheme_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("source = 'src2'").select("doc_id", tx.grapheme_length(F.col("text")).alias("graphemes"))


@query("SELECT conv_id, turn, CASE WHEN text LIKE '=%' OR text LIKE '+%' OR text LIKE '-%' OR text LIKE '@%' THEN '''' || text ELSE text END AS cell FROM conversations")
def csv_injection_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.csv_safe(F.col("text")).alias("cell"))


@query("SELECT event_id, 'user=' || user_id || ' token=***' AS line FROM events WHERE event_id < 500")
def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_id < 500")
    return e.select("event_id", tx.mask_secrets(F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" token=abc"), F.col("event_id").cast("string"))).alias("line"))


@query("SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM (SELECT doc_id, trim(text) AS text FROM documents WHERE source = 'src4')")
def collapse_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("source = 'src4'").select("doc_id", tx.collapse_space(F.col("text")).alias("flat"))
