"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockloom.llm.common import written


def _stars(pairs: DataFrame) -> DataFrame:
    """v, m -> the least neighbour of each v (v and m may come in any number)."""
    return pairs.groupBy("v").agg(F.min("m").alias("low"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) for every node of ``edges`` (a, b).

    Rounds of large-star (every greater neighbour is linked to the least one) and
    small-star (every lesser neighbour likewise) turn each component into a star; their
    number grows with the logarithm of the longest path. Each step is a minimum per
    node, combined before the shuffle, and an equality join; each round is a written
    table. Loops and repeated edges change nothing; null ends are ignored.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionAll(now.select("m", "m").distinct())
        mark = new
        both = now.unionAll(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = _stars(both).select("v", F.least("v", "low").alias("low"))
        large = both.join(low, "v").filter("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        least = _stars(large)
        small = large.join(least, "v").filter("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        now = written(small.unionAll(least.select("v", F.col("low").alias("m"))).distinct(), "edges")
