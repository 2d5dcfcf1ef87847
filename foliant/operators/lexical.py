"""Keyword search: BM25 over trigram phrases plus a substring fallback for short terms.

A term of three or more characters is a phrase of trigrams, which is a substring match, so one
pass over the corpus counts occurrences, one aggregate gives the corpus statistics and the
document frequency of every term, and scores follow from a projection.  Terms are literals of
the plan: nothing is joined but a one-row aggregate.

For many queries over a corpus that stays, :func:`write_index` keeps positional postings, in folders
by trigram bucket and sorted by trigram, with each document's length beside them.  A query then
reads the postings of its own trigrams and nothing else: the folder and the row groups are pruned,
phrases are matched on positions, and no text is read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import occurrences, segments

MATCH_TERMS, LIKE_TERMS = 32, 8
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class KeywordQuery:
    """match: terms ranked by BM25; like: two-character terms found by substring."""

    match: tuple[str, ...]
    like: tuple[str, ...]

    @property
    def is_empty(self) -> bool:
        return not self.match and not self.like


def is_cjk(text: str) -> bool:
    return "⺀" <= text[0] <= "鿿" or "가" <= text[0] <= "힯" or "豈" <= text[0] <= "﫿"


def build_query(text: str | None) -> KeywordQuery:
    """Single characters are dropped, pairs are looked up by substring, longer words are phrases
    and longer CJK runs are cut into their trigrams; both lists are distinct and capped."""
    match: dict[str, None] = {}
    like: dict[str, None] = {}
    for s in segments(text or ""):
        if len(s) == 2:
            like.setdefault(s)
        elif len(s) > 2 and is_cjk(s):
            for i in range(len(s) - 2):
                match.setdefault(s[i : i + 3])
        elif len(s) > 2:
            match.setdefault(s)
    return KeywordQuery(tuple(match)[:MATCH_TERMS], tuple(like)[:LIKE_TERMS])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bm25(docs: DataFrame, terms: tuple[str, ...], id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, score) of the best ``limit`` rows that hold a term."""
    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    counted = docs.select(F.col(id_col), F.greatest(F.length(text_col) - 2, F.lit(0)).alias("_len"), *(occurrences(lowered, t).alias(f"_f{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))
    return _ranked(counted, stats, len(terms), id_col, limit)


def _ranked(counted: DataFrame, stats: DataFrame, n_terms: int, id_col: str, limit: int) -> DataFrame:
    """The best rows by the occurrences _f0, _f1, ... of each term and a length _len, with the
    one-row statistics _n, _avg and document frequencies _d0, _d1, ..."""
    hit = counted.filter(" OR ".join(f"_f{i} > 0" for i in range(n_terms)))

    def part(i: int) -> Column:
        df, f = F.col(f"_d{i}"), F.col(f"_f{i}")
        idf = F.ln((F.col("_n") - df + 0.5) / (df + 0.5))
        return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * f * (K1 + 1) / (f + K1 * ((1 - B) + B * F.col("_len") / F.col("_avg")))

    score = sum((part(i) for i in range(1, n_terms)), part(0))
    return hit.join(F.broadcast(stats)).select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def substring_hits(docs: DataFrame, terms: tuple[str, ...], id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, score): the number of terms a row contains; only ASCII letters fold."""
    lowered = ascii_lower(F.col(text_col))
    score = sum((F.contains(lowered, F.lit(ascii_lower_text(t))).cast("int") for t in terms), F.lit(0))
    return docs.select(id_col, score.cast("double").alias("score")).filter("score > 0").orderBy(F.desc("score"), id_col).limit(limit)


def ascii_lower_text(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def keyword_search(docs: DataFrame, query: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """(id, score): both branches are cut to ``limit`` before their scores are added.  With an index
    of the same documents, phrases come from it; substrings of two characters are always scanned."""
    q = build_query(query)
    parts = []
    if q.match:
        parts.append(indexed_bm25(index, q.match, id_col, limit) if index else bm25(docs, q.match, id_col, text_col, limit))
    if q.like:
        parts.append(substring_hits(docs, q.like, id_col, text_col, limit))
    if not parts or limit <= 0:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(id_col).agg(F.sum("score").alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


BUCKETS = 256


@dataclass(frozen=True)
class Index:
    """postings: (bucket, trigram, id, len, at); stats: one row (_n, _avg)."""

    postings: DataFrame
    stats: DataFrame


def trigram_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Positional postings of every text, null and short ones counted in the statistics only.

    Positions count UTF-16 units, as those of the query's trigrams do."""
    length = F.greatest(F.length(text_col) - 2, F.lit(0))
    lowered = F.lower(F.col(text_col))
    grams = F.posexplode(F.regexp_extract_all(lowered, F.lit("(?s)(?=(...))"), F.lit(1))).alias("place", "trigram")  # one pass, overlapping
    placed = docs.filter(F.length(lowered) >= 3).select(id_col, length.alias("len"), grams)
    postings = placed.groupBy("trigram", id_col, "len").agg(F.collect_list("place").alias("at"))
    bucket = F.pmod(F.crc32(F.encode("trigram", "UTF-8")), F.lit(BUCKETS)).cast("int")
    return Index(postings.select(bucket.alias("bucket"), "trigram", id_col, "len", "at"), docs.agg(F.count("*").alias("_n"), F.avg(length).alias("_avg")))


def write_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", files_per_bucket: int = 1) -> Index:
    """Write the index: a folder for each bucket, its files sorted by trigram so that row groups
    can be skipped.  ``files_per_bucket`` grows with the corpus: a hot trigram's postings are dealt
    out by document, so that no task holds them all."""
    index = trigram_index(docs, id_col, text_col)
    deal = F.pmod(F.xxhash64(id_col), F.lit(files_per_bucket))
    rows = index.postings.repartition(BUCKETS * files_per_bucket if files_per_bucket > 1 else docs.sparkSession.sparkContext.defaultParallelism * 2, "bucket", deal)
    rows.sortWithinPartitions("bucket", "trigram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def _places(term: str) -> list[tuple[int, str]]:
    """(offset in UTF-16 units, trigram) of a term."""
    return [(len(term[:i].encode("utf-16-le")) // 2, term[i : i + 3]) for i in range(len(term) - 2)]


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def indexed_bm25(index: Index, terms: tuple[str, ...], id_col: str, limit: int) -> DataFrame:
    """What :func:`bm25` gives, from the postings of the terms' trigrams alone."""
    grams = sorted({g for t in terms for _, g in _places(t)})
    buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
    read = index.postings.filter(F.col("bucket").isin(buckets) & F.col("trigram").isin(grams))
    by_doc = read.groupBy(id_col).agg(F.first("len").alias("_len"), *(F.flatten(F.collect_list(F.when(F.col("trigram") == g, F.col("at")))).alias(f"_g{i}") for i, g in enumerate(grams)))

    def count(term: str) -> Column:
        places = [_moved(F.col(f"_g{grams.index(g)}"), o) for o, g in _places(term)]
        found = places[0]
        for p in places[1:]:
            found = F.array_intersect(found, p)
        return F.size(found)

    counted = by_doc.select(id_col, "_len", *(count(t).alias(f"_f{i}") for i, t in enumerate(terms)))
    frequencies = counted.agg(*(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))
    return _ranked(counted, index.stats.join(F.broadcast(frequencies)), len(terms), id_col, limit)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, id, tf): the inverted index for many queries, clustered by trigram on write."""
    lowered = F.lower(F.col(text_col))
    grams = F.regexp_extract_all(lowered, F.lit("(?s)(?=(...))"), F.lit(1))  # one pass, overlapping
    return docs.filter(F.length(lowered) >= 3).select(id_col, F.explode(grams).alias("trigram")).groupBy("trigram", id_col).agg(F.count("*").alias("tf"))


#: Characters counted at once, and distinct trigrams that a task holds before it merges or emits them.
PIECE, HELD = 4 << 20, 1 << 20


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(trigram, n): how often each trigram occurs in all texts, lower-cased character by character.

    A batch of texts is counted as arrays of code points where it lies, so that a task exchanges its
    distinct trigrams and not those of each document."""
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_counts, "trigram string, n long")
    return counted.groupBy("trigram").agg(F.sum("n").alias("n"))


@cache
def _lower_table() -> np.ndarray:
    return np.array([ord(chr(c).lower()[0]) for c in range(sys.maxunicode + 1)], np.uint32)


def _count_codes(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the trigrams at the marked places; a key is three code points of 21 bits."""
    present = np.zeros(sys.maxunicode + 1, np.bool_)
    present[codes] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(len(present), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    c, a = place[codes], len(alphabet)
    key = ((c[:-2] * a + c[1:-1]) * a + c[2:])[starts]
    if a**3 <= 4 * len(codes) + (1 << 16):
        n = np.bincount(key)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    return alphabet[key // a // a] << 42 | alphabet[key // a % a] << 21 | alphabet[key % a], n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lower, keys, counts = _lower_table(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def merge() -> None:
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, which, np.concatenate(counts))
        keys[:], counts[:] = [key], [n]

    def emit() -> pa.RecordBatch:
        key = keys[0]
        letters = np.stack((key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF), 1).astype("<u4").tobytes().decode("utf-32-le")
        out = pa.RecordBatch.from_pydict({"trigram": pa.array([letters[i : i + 3] for i in range(0, len(letters), 3)], pa.string()), "n": pa.array(counts[0], pa.int64())})
        keys[:], counts[:] = [key[:0]], [counts[0][:0]]
        return out

    for batch in batches:
        texts = [t.decode("utf-8", "replace") for t in batch.column(0).cast(pa.binary()).to_pylist() if t]
        size = np.array([len(t) for t in texts], np.int64)
        end, whole = np.cumsum(size), "".join(texts)
        starts = np.ones(len(whole), np.bool_)
        starts[end - 1] = False
        starts[end[size > 1] - 2] = False
        for at in range(0, len(whole), PIECE):
            codes = lower[np.frombuffer(whole[at : at + PIECE + 2].encode("utf-32-le"), "<u4")]
            if len(codes) < 3:
                continue
            key, n = _count_codes(codes, starts[at : at + len(codes) - 2])
            keys.append(key)
            counts.append(n)
            if sum(map(len, keys)) > HELD:
                merge()
                if len(keys[0]) > HELD // 2:
                    yield emit()
    merge()
    yield emit()


def candidates(index: DataFrame, terms: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Rows that hold all trigrams of some term: a prefilter for :func:`bm25` over many rows."""
    out = None
    for t in terms:
        grams = sorted({t[i : i + 3] for i in range(len(t) - 2)})
        found = index.filter(F.col("trigram").isin(grams)).groupBy(id_col).agg(F.countDistinct("trigram").alias("n")).filter(F.col("n") == len(grams)).select(id_col)
        out = found if out is None else out.union(found)
    return out.distinct()
