"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.storage import Scratch, by_shuffle


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node on an edge of ``edges(a, b)``.

    ``component`` is the smallest node reachable. Self-loops, nulls, repeated
    and reversed edges are allowed. Each round links every neighbour of a node
    to the smallest node around it, first the larger neighbours, then the
    smaller ones; a node's edges are never gathered in one row, so a hub costs
    no more memory than any other node. Rounds are written to the shared folder.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    now = scratch.write(_down(edges.select("a", "b")), "round0")
    before = None
    for k in range(1, rounds + 1):
        now = scratch.write(_small(_large(now)), f"round{k}")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"round{k - 1}")
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node a to the smaller node b."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _down(by_shuffle(edges).join(low.withColumnRenamed("u", "b"), "b").select("a", F.col("m").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = by_shuffle(edges).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved.unionByName(low.select("a", F.col("m").alias("b"))))
