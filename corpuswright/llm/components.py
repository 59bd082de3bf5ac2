"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Hang the neighbours of each node a, as far as `keep` says, on the least node of its neighbourhood."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return pairs.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    # order-free sum of row hashes; the two differ between rounds unless the edges are the same
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node of the component.

    No edges give no rows. Loops and repeated edges do no harm; nodes of any orderable type, never null.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct(), "components")
    seen = _state(edges)
    while seen[0]:
        large = _star(_both_ways(edges), F.col("b") > F.col("a"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        edges = cut_lineage(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "components")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
