"""Connected components of a graph of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongbox.llm.tables import with_hot, written


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b), the smallest node that each node reaches: node, component. Nodes without a link
    to another are left out. Every round is written down; none holds a component in one task, and the
    edges of a node that has very many are not shuffled to meet.

    Each round hangs the larger neighbours of a node on the smallest one, then the smaller ones; the
    number of rounds grows with the logarithm of the longest chain."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = written(edges, "links"), None
    while (state := _state(edges)) != before:
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = with_hot(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = with_hot(large, least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
