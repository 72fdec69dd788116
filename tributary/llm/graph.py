"""Connected components without pairs inside a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import durable


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node in ``links(a, b)``; the root is the smallest node that can be reached.

    Star contraction (Kiveris et al., 2014): each round links every node's larger
    neighbours to its smallest one, then its smaller ones likewise. The number of
    links never grows and rounds grow with the logarithm of a component's size.
    Each round is written to the shared folder, so no round is computed twice.
    """
    spark = links.sparkSession
    edges = durable(_descending(links), "links")
    if edges.isEmpty():
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, root {edges.schema['a'].dataType.simpleString()}")
    before = None
    for _ in range(max_rounds):
        edges = durable(_small_star(_large_star(edges)), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _descending(links: DataFrame) -> DataFrame:
    """Links as (larger, smaller), each once."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them; ``edges`` hold (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
