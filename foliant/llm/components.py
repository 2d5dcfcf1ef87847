"""Connected components of a graph of any size, as DataFrames.

Large-star and small-star steps in turn: each keeps connectivity and never raises the number of
edges, and the rounds grow with the logarithm of the graph.  Each step's table is written to the
shared folder, so a lost executor costs one step.  The rows of a hub meet their minimum in a join
of two written tables, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, discard


def _star(edges: DataFrame, label: str, large: bool) -> DataFrame:
    """edges: (u, v).  large: u's larger neighbours go to its least one; else u and its smaller
    neighbours do (edges then run from the larger node to the smaller)."""
    if large:
        pairs = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
    if large:
        out = pairs.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = pairs.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    result = cut(out.filter("u != v").distinct(), f"{label}-{'large' if large else 'small'}")
    discard(least)
    return result


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b), both long; component is the least
    node reachable.  Repeated edges and loops do no harm; no edges give no rows."""
    pairs = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), label)
    before, now = None, _mark(pairs)
    while now != before and now[0]:
        larger = _star(pairs, label, True)
        smaller = _star(larger, label, False)
        discard(pairs, larger)
        pairs, before, now = smaller, now, _mark(smaller)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
