"""Registered queries: streams over the events table, each with its batch twin as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.streaming import activity

from .registry import query, table


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.source(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)


def _zoneless(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoneless(activity.run_available(activity.tumbling(_stream(spark, sf_dir), at="ts", kind="event_type", width="1 hour")))


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS start, event_type FROM events, (VALUES (0), (1)) v(k)) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoneless(activity.run_available(activity.sliding(_stream(spark, sf_dir), at="ts", kind="event_type", width="2 hours", step="1 hour")))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '1 hour' AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoneless(activity.run_available(activity.sessions(_stream(spark, sf_dir), at="ts", key="user_id", gap="1 hour")))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = activity.distinct_events(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), at="ts", keys=["user_id", "event_type"], late="60 days")
    return activity.run_available(s, "append").select("user_id", "event_type")
