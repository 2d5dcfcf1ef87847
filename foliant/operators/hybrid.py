"""Hybrid search: reciprocal-rank fusion of keyword and vector rankings, then result shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import Index, keyword_search
from .vector import top_k

RRF_K, MOST_HITS, PER_FILE = 60, 200, 3
SEMANTIC, KEYWORD = 1, 2


def candidate_count(k: int, filtered: bool) -> int:
    return max(4 * k, 30) * (5 if filtered else 1)


def ranked(hits: DataFrame, id_col: str) -> DataFrame:
    """A ranking of at most some hundred rows gets its places (one task by nature of a top-k)."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def fuse(semantic: DataFrame | None, keyword: DataFrame | None, id_col: str) -> DataFrame:
    """(id, score, kinds, semantic_rank) by the sum of 1/(60+rank); kinds is a bit mask."""
    parts = []
    for hits, kind in ((semantic, SEMANTIC), (keyword, KEYWORD)):
        if hits is not None:
            parts.append(ranked(hits, id_col).select(id_col, "rank", F.lit(kind).alias("kind")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(id_col).agg(
        F.sum(1.0 / (F.lit(RRF_K) + F.col("rank"))).alias("score"),
        F.bit_or("kind").alias("kinds"),
        F.coalesce(F.min(F.when(F.col("kind") == SEMANTIC, F.col("rank"))), F.lit(2**31 - 1)).alias("semantic_rank"),
    )


def under_prefix(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; case and kind of slash don't matter."""
    p = prefix.replace("\\", "/").rstrip("/").lower()
    c = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (c == p) | F.startswith(c, F.lit(p + "/"))


def shape(fused: DataFrame, details: DataFrame, k: int, *, id_col: str, path_col: str, prefixes: list[str] | None = None, per_file: int = PER_FILE) -> DataFrame:
    """Details of fused hits: unknown ids and other folders go, then at most ``per_file`` a file
    and k in all; scores are relative to the first hit."""
    hits = fused.join(details, id_col)
    if prefixes:
        under = under_prefix(F.col(path_col), prefixes[0])
        for p in prefixes[1:]:
            under = under | under_prefix(F.col(path_col), p)
        hits = hits.filter(under)
    order = [F.desc("score"), F.asc("semantic_rank"), F.asc(id_col)]
    hits = hits.withColumn("_in_file", F.row_number().over(Window.partitionBy(F.lower(path_col)).orderBy(*order))).filter(F.col("_in_file") <= per_file)
    top = hits.orderBy(*order).limit(k)
    return top.withColumn("score", F.col("score") / F.first("score").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_in_file")


def search(chunks: DataFrame, query: str, k: int, *, vectors: DataFrame | None = None, query_vector: list[float] | None = None, prefixes: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", vector_id: str = "vec_id", index: Index | None = None) -> DataFrame:
    """Hits with score, kinds and ``degraded`` (no vectors took part).

    A blank query or k of 0 gives no hit and isn't degraded."""
    k = min(k, MOST_HITS)
    empty = chunks.limit(0).withColumns({"score": F.lit(0.0), "kinds": F.lit(0), "semantic_rank": F.lit(0), "degraded": F.lit(False)})
    if not query.strip() or k <= 0:
        return empty
    n = candidate_count(k, bool(prefixes))
    degraded = vectors is None or query_vector is None
    semantic = None if degraded else top_k(vectors, query_vector, n, id_col=vector_id).withColumnRenamed(vector_id, id_col)
    keyword = keyword_search(chunks, query, n, id_col=id_col, text_col=text_col, index=index)
    fused = fuse(semantic, keyword, id_col)
    order = [F.desc("score"), F.asc("semantic_rank"), F.asc(id_col)]
    fused = fused.orderBy(*order).limit(n if degraded else 2 * n)
    return shape(fused, chunks, k, id_col=id_col, path_col=path_col, prefixes=prefixes).withColumn("degraded", F.lit(degraded))
