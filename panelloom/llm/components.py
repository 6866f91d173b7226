"""Connected components of a graph held as rows, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (a, b).

    Large-star and small-star steps in turn: every step moves links towards the smallest neighbour,
    so long chains halve, and a hub's links are pre-aggregated before they are shuffled. Steps go on until
    nothing changes. Nodes may be of any type with an order; links of a node with itself are none.
    """
    links = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: each larger neighbour of a node gets the smallest of the node's neighbours
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        # small star: the smaller neighbours of a node, and it, get the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        now = durable(small)
        if _same(links, now):
            break
        links = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _same(a: DataFrame, b: DataFrame) -> bool:
    """By count and two sums of hashes, a few numbers each."""
    sums = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return sums(a) == sums(b)
