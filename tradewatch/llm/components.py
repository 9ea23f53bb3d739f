"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and one join, so a node with many
neighbours is never gathered in one task; the adaptive skew join splits its rows. Each round is
written to the shared folder, which cuts the lineage. The number of rounds grows with the
logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewatch.llm.common import sorted_side, written


def _both_ways(e: DataFrame) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return e.select(pair.alias("p")).select("p.*")


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest node around u."""
    n = _both_ways(e)
    least = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return n.filter("b > a").join(sorted_side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u (the larger end of every edge) and its smaller neighbours are tied to the least of them."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    out = e.join(sorted_side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of comparable ids to (node, root) for every node on an edge, root being
    the smallest node reachable. NULL ends and loops are ignored; no edges give no rows."""
    e = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        e = written(_small_star(_large_star(e)), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
