"""Connected components of a large sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._storage import settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternates two star contractions: each node hands its larger neighbours to its
    smallest one, then its smaller ones. Every step is a map-side combined minimum and an
    equi-join on the node, so a node of very high degree is split by the skewed-join rule,
    and edges never outnumber those given. Each round is written to the shared folder.
    Empty input gives no rows; self-loops and repeated edges are ignored. It ends when every edge leads
    to a root: then no node has two edges up, and none that has one is itself led to.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = settle(edges, "graph")
    for _ in range(rounds):
        if not _unfinished(edges):
            break
        edges = settle(_small_star(_large_star(edges)), "graph")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _unfinished(edges: DataFrame) -> bool:
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.union(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").limit(1).count() > 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hand = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    own = least.select("a", F.col("m").alias("b"))
    return hand.union(own).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
