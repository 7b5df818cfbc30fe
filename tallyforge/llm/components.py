"""Connected components by alternating star contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, dealt_anew


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is its smallest node.

    Alternates large-star and small-star steps; each shuffles the edges once for the minimum of each node
    and once to re-hang them, and writes the result to the shared folder. A hot node is pre-aggregated for its minimum, and split
    by the skew join. It ends when a round leaves the edges as they are. Empty edges give
    an empty result; an edge from a node to itself gives that node alone.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = e.where("a = b").select("a", "b")
    e = e.where("a > b")
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = dealt_anew(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt_anew(low, "a"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    every = loops.union(e).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
