"""Connected components of large link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import materialised


def digest(edges: DataFrame) -> tuple:
    """Number of edges and the exclusive or of their hashes, which no number of edges can overflow."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that a link names; component is the smallest node reachable.

    Alternates the large-star and small-star steps: each node's neighbours are hung on its smallest neighbour until
    every tree is a star. A step is a minimum per node (summed up before the shuffle) and a join, so a node with
    very many links is split like any skewed join key. Loops (a = b) keep a node alone; nulls are left out.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    loops = links.where("a = b").select("a", "b")
    edges = materialised(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), narrow=True)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        edges = materialised(small, narrow=True)
        now = digest(edges)
        if now == before:
            break
        before = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).union(loops.toDF("node", "component")).groupBy("node").agg(F.min("component").alias("component"))
