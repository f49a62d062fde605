"""Connected components by alternating large-star and small-star rounds over an edge table.

Every round is two aggregates and two joins, written to the shared folder; no node's neighbours and
no component are gathered in a task or on the driver. Each round points the nodes of a tree at
smaller ones, and the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.io import freed, written


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with the least of u and its v's: (u, v, least).

    The least ones are written, so that the join deals out its own rows and a star's centre can be split among tasks.
    """
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least")), "least")
    return pairs.join(least, "u")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of the edges (u, v); self-loops are ignored."""
    edges = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(edges.distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large")
        small = _star(large)
        turned = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v")))
        before, edges = edges, written(turned.filter("u != v").distinct(), "stars")
        freed(before, large)
        if (now := _mark(edges)) == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
