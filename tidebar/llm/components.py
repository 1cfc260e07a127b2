"""Connected components of a link table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar.session import cut_lineage

EDGES = 100_000  # edges per task


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of links (a, b).

    Alternates two steps until nothing changes: every node hands its larger neighbours to the
    smallest node it knows, then its smaller ones.  Paths shrink fast whatever the shape of the
    graph.  The neighbours of a node are never gathered: only a minimum per node is, and it is
    joined back to the edges.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges)
    state = _state(edges)
    while True:
        few = max(4, state[0] // EDGES + 1)  # the shuffle's partitions are read by as many tasks as the edges need
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct().coalesce(few))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct().coalesce(few))
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1000003))).first())
