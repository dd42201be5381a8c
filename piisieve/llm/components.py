"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); root is the component's smallest node.

    Alternates large-star and small-star steps: in each, nodes hook neighbours to the smallest
    node they see, so the number of rounds grows with the logarithm of a component's diameter.
    Every step is an aggregation (combined before its shuffle) and an equi-join with its
    result; the result is a staged table, so that skewed join keys can be split. Null nodes
    and self-loops are ignored; no edges give no rows.
    """
    e = staged(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        e = _hooked(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True)
        e = _hooked(e, large=False)
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _hooked(e: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v); the result has u > v."""
    least = staged(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    joined = e.join(least, "u")
    if large:      # every larger neighbour hooks to the smallest one
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:          # the node and its smaller neighbours hook to the smallest one
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return staged(out.where("u <> v").distinct(), "star")
