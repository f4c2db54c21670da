"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadloom.session import durable


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): every node that occurs in ``links`` (u, v), with the smallest node it reaches.

    Links with a NULL end and loops name no connection; a node seen only in loops is left out. Repeated links
    and both directions are fine; no links give no rows.

    A large-star step ties every greater neighbour of a node to its smallest neighbour, a small-star step ties
    the node and its smaller neighbours to the smallest one; the graph ends as one star per component after
    about log^2 rounds. Neighbourhoods are only ever reduced to their minimum and joined back, never gathered,
    so a hub with very many links is a skewed join, which adaptive execution splits. Each round's links are
    written to the shared folder: lost executors cost a re-read.
    """
    ends = (F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = durable(links.filter("u <> v").select(*ends).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours v > u point to m.
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(
            "u <> v").distinct()
        # Small star: every edge now runs from the greater end u to the smaller end v.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u")
        edges = durable(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(
            small.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
