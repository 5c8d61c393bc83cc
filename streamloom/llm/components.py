"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, scratch, written


def components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of edges (``a``, ``b``): ``node``, ``root`` (its smallest
    node), for every node that has an edge to another.

    Alternates two contractions until nothing changes: every node hangs its larger neighbours, then
    its smaller ones, on the smallest of them. Their number grows with the logarithm of the graph's
    diameter; each is two aggregations that combine in the map tasks, and its result is written to
    the shared folder; what a round needs beside it goes with the round. Nodes of very many neighbours are
    broadcast to their edges (``joined_hot``). Edges, nodes and roots never come to the driver, only two sums do.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
        with scratch(edges.sparkSession) as keep:
            now = keep(_contracted(now, 2 * state["n"]))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _contracted(now: DataFrame, most: int) -> DataFrame:
    """One round: larger neighbours, then smaller ones, hung on the smallest. ``most`` bounds the rows of both joins."""
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
    large = joined_hot(both, least, ["a"], most).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    large = written(large)
    least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    small = joined_hot(large, least, ["a"], most).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return small.filter("a <> b").select("a", "b").distinct()
