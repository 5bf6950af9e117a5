"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrostar.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s"),
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b), where root is
    the smallest node reachable; the root itself has no row.

    Each round hangs neighbours on the smallest neighbour, first the larger
    ones (large star), then the smaller ones (small star), which takes
    O(log^2 n) rounds for any shape.  A round is a few joins on unique keys,
    whose unique sides are stored too: both sides are then plain shuffles, and
    AQE can split the hub of a large component.  A round is written to the
    shared folder, so lineage stays one round long; the driver sees one
    signature row a round.
    """
    e = stored(edges.where("a <> b").distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = stored(least.select("a", F.least("a", "m").alias("m")), "edges-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "edges-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "edges-least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = stored(small, "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
