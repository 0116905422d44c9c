"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def star_roots(edges: DataFrame) -> DataFrame:
    """For edges (a, b) over longs: one row (node, root) per node that is not the smallest of its component.

    Each round writes its edges, so lineage stays short and a lost executor costs one round. Minima are taken by
    partial aggregation and edges are moved by equi-joins, which split where a node has very many edges.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        # Large star: every neighbour above a node is tied to the smallest of the node and its neighbours.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        now = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        # Small star: a node and its neighbours below are tied to the smallest of them.
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        moved = now.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(moved.union(low.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
