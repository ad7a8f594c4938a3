"""Connected components by contraction: every node joins the neighbour of lowest random rank, round after round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscillar.llm.common import discard, written


def components(edges: DataFrame, kind: str) -> DataFrame:
    """node → root for every node of the edges (columns a, b of SQL type kind); equal roots mean one component.

    The rank of a node is a hash salted by the round, so a path shrinks as fast as a star: expected rounds grow with the
    logarithm of the longest path. Aggregates are minima, combined before the shuffle; no node's neighbours are collected.
    Each round is written to the shared folder. No edges give an empty table.
    """
    spark = edges.sparkSession
    edges = written(edges.select("a", "b").filter("a <> b"), "edges")
    roots = None
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("r"), F.col("b").alias("to"))).alias("low"))
        own = F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), F.col("node").alias("to"))
        step = written(near.select("node", F.least("low", own).getField("to").alias("to")), "hops")
        if roots is None:
            roots = written(step.withColumnRenamed("to", "root"), "roots")
        else:
            before = roots
            roots = written(roots.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            discard(before)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = written(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(edges, step)
        edges = left
        turn += 1
    if roots is None:
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    return roots
