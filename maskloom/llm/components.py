"""Connected components of a graph whose edges and nodes stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (a, b), longs, and the smallest node that it can reach.

    Large-star and small-star steps by turns until only stars are left: every node is hung on the
    smallest it knows of. A node with very many neighbours is one group of a sum that
    combines on the map side, and the small side of a join.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while not _are_stars(now):
        least = now.unionAll(now.select(b.alias("a"), a.alias("b"))).groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = now.join(least, "b").select("a", F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        small = small.unionAll(lowest.select("a", F.col("m").alias("b")))
        now = stored(small.where(a != b).distinct(), "edges")
    return now.select(a.alias("node"), b.alias("component")).unionAll(now.select(b.alias("node"), b.alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (a, b), a > b, without repeats, is the centre b of some or the a of one."""
    end = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("upper")),
                            F.struct(F.col("b").alias("node"), F.lit(0).alias("upper"))))
    nodes = edges.select(end.alias("end")).groupBy("end.node").agg(F.sum("end.upper").alias("upper"), F.count("*").alias("n"))
    return not nodes.agg(F.count_if((F.col("upper") > 0) & (F.col("n") > 1))).first()[0]
