"""Activity rollups and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from foliant.functions.text import csv_safe


def summary(events: DataFrame, *, client: str, kind: str, at: str, id_col: str, kinds: dict[str, str], version: str | None = None, detail: str | None = None, error_kind: str | None = None) -> DataFrame:
    """Per client: last time of each kind, and the latest version and error text."""
    when = lambda k: F.when(F.col(kind) == k, F.col(at))
    aggs = [F.max(when(k)).alias(name) for name, k in kinds.items()]
    if version:
        aggs.append(F.max_by(version, F.struct(at, id_col)).alias("version"))
    if detail and error_kind:
        aggs.append(F.max_by(detail, F.when(F.col(kind) == error_kind, F.struct(at, id_col))).alias("last_error"))
    return events.groupBy(client).agg(*aggs)


def client_state(connected: Column, called: Column, failed: Column, now: Column, *, fresh_minutes: int = 10) -> Column:
    """Error if that is the latest, active if a call is fresh, connected, or never seen."""
    last = F.greatest(connected, called)
    return (
        F.when(failed.isNotNull() & (last.isNull() | (failed > last)), "error")
        .when(called.isNotNull() & (called >= now - F.expr(f"INTERVAL {fresh_minutes} MINUTES")), "active")
        .when(last.isNotNull(), "connected")
        .otherwise("never")
    )


def classify(name: Column, exact: dict[str, str], contains: list[tuple[str, str]], other: str = "other") -> Column:
    """The owner of a client: exact names first, then substrings in their order."""
    low = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for part, owner in reversed(contains):
        out = F.when(F.contains(low, F.lit(part)), owner).otherwise(out)
    for full, owner in exact.items():
        out = F.when(low == full, owner).otherwise(out)
    return F.coalesce(out, F.lit(other))


def merge_owners(summaries: DataFrame, owner: Column, times: list[str]) -> DataFrame:
    return summaries.groupBy(owner.alias("owner")).agg(*(F.max(t).alias(t) for t in times))


def per_minute(events: DataFrame, *, at: str, kind: str, newest: int = 5) -> DataFrame:
    """The newest one-minute buckets of each kind with counts and the last event's time."""
    rolled = events.groupBy(F.window(at, "1 minute").alias("w"), kind).agg(F.count("*").alias("n"), F.max(at).alias("last_at"))
    return rolled.select(F.col("w.start").alias("minute"), kind, "n", "last_at").orderBy(F.desc("last_at"), kind).limit(newest)


def failed_files(documents: DataFrame, reasons: dict[str, str], other: str) -> DataFrame:
    """(path, reason, error) of failed documents, safe for a spreadsheet; errors that ``reasons``
    doesn't name get the text for others."""
    reason = F.lit(other)
    for code, text in reasons.items():
        reason = F.when(F.col("error") == code, text).otherwise(reason)
    return documents.filter("status = 'failed'").select(csv_safe(F.col("path")).alias("path"), reason.alias("reason"), csv_safe(F.col("error")).alias("error"))


def folder_states(documents: DataFrame, now: Column, *, folder: str = "folder", fresh_minutes: int = 5) -> DataFrame:
    """(folder, state, n, n_failed, n_fresh): problem where a document failed, running where one
    waits, done else; n_fresh were updated in the last minutes."""
    failed, waits = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status").isin("waiting", "pending"))
    fresh = F.count_if(F.col("updated_at") >= now - F.expr(f"INTERVAL {fresh_minutes} MINUTES"))
    out = documents.groupBy(folder).agg(F.count("*").alias("n"), failed.alias("n_failed"), waits.alias("_waits"), fresh.alias("n_fresh"))
    return out.select(folder, F.when(F.col("n_failed") > 0, "problem").when(F.col("_waits") > 0, "running").otherwise("done").alias("state"), "n", "n_failed", "n_fresh")


def counted_up_to(df: DataFrame, most: int) -> tuple[int, bool]:
    """(rows, whether there are more), looking at no more than ``most`` + 1 rows."""
    n = df.limit(most + 1).count()
    return min(n, most), n > most


def evaluate(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall@k and mean reciprocal rank.

    ranked: query_id, rank, file; expected: query_id, file, observe_only."""
    gated = expected.filter("NOT observe_only")
    first = ranked.join(gated.select("query_id", "file"), ["query_id", "file"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return scores(gated.select("query_id").distinct().join(first, "query_id", "left"), ks)


def scores(every: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall@k and mean reciprocal rank of (query_id, rank), a row for each query; a null rank is a miss."""
    recall = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return every.agg(F.count("*").alias("queries"), *recall, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def upper_median(df: DataFrame | GroupedData, column: str) -> DataFrame:
    """(least, median, largest) with the upper of two middle values, by order statistic; of each
    group, where df is grouped."""
    return df.agg(F.min(column).alias("least"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)").alias("median"), F.max(column).alias("largest"))


def mode(df: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """The most frequent value of each group; of equals the smallest."""
    n = F.sum(weight) if weight else F.count("*")
    counts = df.groupBy(*group, value).agg(n.alias("_n"))
    w = Window.partitionBy(*group).orderBy(F.desc("_n"), F.asc(value))
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*group, value)
