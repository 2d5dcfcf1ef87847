"""Keeping a store in step with folders: differences, moves, gates and queues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASS_LEAST, MASS_SHARE, HOLD_HOURS = 20, 0.3, 24
PARTIAL_PATHS, WATCH_PATHS = 200, 500
RETENTION_DAYS, RETRY_MINUTES = 30, 5


def needs_work(now: Column | None = None) -> Column:
    """Over disk_* and the stored columns: size or time differs, the size cap flips, or a locked
    file's retry is due."""
    now = F.current_timestamp() if now is None else now
    waiting = F.col("next_retry_at").isNotNull() & (F.col("next_retry_at") > now)
    differs = (F.col("disk_size") != F.col("size_bytes")) | (F.col("disk_mtime") != F.col("mtime")) | (F.col("disk_too_large") != F.col("too_large")) | F.col("next_retry_at").isNotNull()
    return ~waiting & differs


def reconcile(disk: DataFrame, store: DataFrame, *, readable: Column | None = None, now: Column | None = None) -> DataFrame:
    """(path, change): new, changed, missing or same, over the paths in lower case.

    disk: path, size, mtime, too_large; store: path, size_bytes, mtime, too_large, next_retry_at.
    ``readable``: a condition on the path; what can't be read is neither changed nor missing."""
    d = disk.select(F.lower("path").alias("key"), F.col("path").alias("disk_path"), F.col("size").alias("disk_size"), F.col("mtime").alias("disk_mtime"), F.col("too_large").alias("disk_too_large"))
    s = store.select(F.lower("path").alias("key"), "path", "size_bytes", "mtime", "too_large", "next_retry_at")
    both = d.join(s, "key", "full_outer")
    change = F.when(F.col("path").isNull(), "new").when(F.col("disk_path").isNull(), "missing").when(needs_work(now), "changed").otherwise("same")
    out = both.select(F.coalesce("disk_path", "path").alias("path"), change.alias("change"))
    return out if readable is None else out.withColumn("change", F.when((F.col("change") == "missing") & ~readable, "same").otherwise(F.col("change")))


def confirm(changed: DataFrame, old: DataFrame) -> DataFrame:
    """(path, outcome): a changed file with an equal hash only refreshes its fingerprint."""
    return changed.join(old.select("path", F.col("hash").alias("old_hash")), "path", "left").select("path", F.when(F.col("hash") == F.col("old_hash"), "unchanged").when(F.col("old_hash").isNull(), "added").otherwise("updated").alias("outcome"))


def moves(new: DataFrame, missing: DataFrame) -> DataFrame:
    """(old_path, new_path): new and missing files with equal size and hash, one to one, in path
    order within each hash.  Sizes are joined first, so hashes are only needed where they agree."""
    key = Window.partitionBy("size", "hash").orderBy("path")
    sized = new.join(missing.select("size").distinct(), "size", "left_semi")
    a = sized.withColumn("nth", F.row_number().over(key)).select("size", "hash", "nth", F.col("path").alias("new_path"))
    b = missing.withColumn("nth", F.row_number().over(key)).select("size", "hash", "nth", F.col("path").alias("old_path"))
    return a.join(b, ["size", "hash", "nth"]).select("old_path", "new_path")


def mass_deletion(changes: DataFrame, folder: Column) -> DataFrame:
    """(folder, n_missing, n_known, hold): a folder that lost many files at once is asked about."""
    known = F.col("change") != "new"
    out = changes.groupBy(folder.alias("folder")).agg(F.count_if(F.col("change") == "missing").alias("n_missing"), F.count_if(known).alias("n_known"))
    return out.withColumn("hold", (F.col("n_missing") >= MASS_LEAST) & (F.col("n_missing") > F.col("n_known") * MASS_SHARE))


def still_asked(changes: DataFrame, folder: Column, dismissed: DataFrame, now: Column | None = None) -> DataFrame:
    """(folder, n_missing, n_known, hold, files): as :func:`mass_deletion`, but a folder whose
    question about just these files was dismissed in the last 24 hours isn't asked about.

    ``files`` tells a set of missing paths from another; dismissed: folder, files, at."""
    missing = F.when(F.col("change") == "missing", F.xxhash64(F.lower("path")))
    asked = mass_deletion(changes, folder).join(changes.groupBy(folder.alias("folder")).agg(F.coalesce(F.bit_xor(missing), F.lit(0)).alias("files")), "folder")
    since = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {HOLD_HOURS} HOURS")
    quiet = dismissed.filter(F.col("at") > since).select("folder", "files").distinct().withColumn("_quiet", F.lit(True))
    return asked.join(quiet, ["folder", "files"], "left").select("folder", "n_missing", "n_known", (F.col("hold") & F.col("_quiet").isNull()).alias("hold"), "files")


def outcomes(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    """(path, status, error, next_retry_at, keep_chunks) of parsed files (path, error).

    A locked file is tried again after some minutes and keeps the chunks it has; one that can't be
    read or takes too long fails and loses them; a truncated one is done."""
    now = F.current_timestamp() if now is None else now
    locked, done = F.col("error") == "locked", F.col("error").isNull() | (F.col("error") == "truncated")
    status = F.when(done, "done").when(locked, "waiting").when(F.col("error") == "unsupported", "skipped").otherwise("failed")
    retry = F.when(locked, now + F.expr(f"INTERVAL {RETRY_MINUTES} MINUTES"))
    return parsed.select("path", status.alias("status"), "error", retry.alias("next_retry_at"), (done | F.coalesce(locked, F.lit(False))).alias("keep_chunks"))


def queue(work: DataFrame) -> DataFrame:
    """Each path once: by priority (the latest first), else the newest file, then the path."""
    best = Window.partitionBy(F.lower("path")).orderBy(F.desc_nulls_last("priority"), F.desc("mtime"))
    once = work.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return once.orderBy(F.desc_nulls_last("priority"), F.desc("mtime"), F.asc("path"))


def scope(paths: list[str], root: str, most: int = PARTIAL_PATHS) -> list[str] | None:
    """The paths of a partial scan, or None for a full one: too many, or one outside the root."""
    base = root.replace("\\", "/").rstrip("/").lower() + "/"
    inside = all((p.replace("\\", "/").lower() + "/").startswith(base) for p in paths)
    return None if len(paths) > most or not inside else paths


@dataclass
class Requests:
    """Scan requests folded together: a full one absorbs partial ones of its folder."""

    everything: bool = False
    folders: set[str] = field(default_factory=set)
    partial: dict[str, set[str]] = field(default_factory=dict)
    retries: set[str] = field(default_factory=set)

    def all(self) -> None:
        self.everything = True
        self.folders.clear()
        self.partial.clear()

    def folder(self, name: str) -> None:
        if not self.everything:
            self.folders.add(name)
            self.partial.pop(name, None)

    def paths(self, name: str, paths: list[str]) -> None:
        if not self.everything and name not in self.folders:
            self.partial.setdefault(name, set()).update(paths)

    def take(self) -> tuple[str, object] | None:
        """Retries, then partial scans, then all folders, then one folder."""
        if self.retries:
            out, self.retries = ("retry", self.retries), set()
            return out
        if self.partial:
            return "partial", self.partial.popitem()
        if self.everything:
            self.everything = False
            return "all", None
        if self.folders:
            return "folder", self.folders.pop()
        return None


def purge(events: DataFrame, now: Column, days: int = RETENTION_DAYS, at: str = "at") -> DataFrame:
    return events.filter(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS"))


def folder_statistics(documents: DataFrame, queued: DataFrame) -> DataFrame:
    """(folder_id, total, failed, pending, indexed) with new files in the queue as pending."""
    docs = documents.groupBy("folder_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"))
    new = queued.groupBy("folder_id").agg(F.count("*").alias("pending"))
    both = docs.join(new, "folder_id", "full_outer").na.fill(0)
    return both.select("folder_id", (F.col("documents") + F.col("pending")).alias("total"), "failed", "pending", (F.col("documents") - F.col("failed")).alias("indexed"))


def remaining_time(durations: DataFrame, remaining: int, *, order: str = "at", column: str = "seconds") -> DataFrame:
    """(eta_s): mean of the last 20 durations times what is left, once 5 are known."""
    last = durations.orderBy(F.desc(order)).limit(20)
    return last.agg(F.when(F.count("*") >= 5, F.avg(column) * remaining).alias("eta_s"))


def remove_repeated_lines(lines: DataFrame, *, least_pages: int = 3) -> DataFrame:
    """Page lines (doc, page, line, text) without headers and footers: a line whose key (lower
    case, no digits or spaces) is on more than half of a document's pages."""
    keyed = lines.withColumn("_key", F.regexp_replace(F.lower("text"), r"[\d\s]+", ""))
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("_pages"))
    seen = keyed.groupBy("doc", "_key").agg(F.countDistinct("page").alias("_on"))
    repeated = seen.join(pages, "doc").filter((F.col("_pages") >= least_pages) & (F.col("_on") * 2 > F.col("_pages")) & (F.col("_key") != "")).select("doc", "_key")
    return keyed.join(repeated, ["doc", "_key"], "left_anti").select(*lines.columns)
