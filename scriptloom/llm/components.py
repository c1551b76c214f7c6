"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import durable


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of the edges: two equal states in turn end the rounds."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links of long ids -> ``(node, label)``, label the smallest id that node reaches.

    Nodes without a link to another node have no row. Neighbour lists are never gathered: each
    round takes a minimum by node (summed before the shuffle) and joins it back, so a node with
    many links costs no more than its rows. Every round is a written table.
    Nulls, loops and repeated links are dropped; no links give an empty table.
    """
    edges = durable(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.union(least).toDF("u", "v").where("u <> v").distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    label = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.union(edges.select("v", "v")).toDF("node", "label").distinct()
