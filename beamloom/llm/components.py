"""Distributed connected components by alternating star contraction.

Each round makes every node point to the smallest neighbour it knows (large star, then small
star), so trees flatten in a number of rounds that grows with the logarithm of the diameter.
Each round is one aggregation and one join on the node id; a node with very many links sends
one partial minimum per task. The join is on a key that neither side is dealt by, so both come through
exchanges of their own and Spark can split the links of such a node over tasks. Edges are cut to
a written table of few files each round, and the table before it is removed. No links or components reach the
driver, only the count of changed edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.llm.shared import compact, dropped, written


def _round(edges: DataFrame, larger_only: bool) -> DataFrame:
    """edges: (u, v) with u > v. Links neighbours to the smallest node seen from their common node."""
    if larger_only:  # large star: neighbours above a node go to the smallest of its neighbourhood
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # small star: neighbours below a node, and the node itself, go to the smallest of them
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    key = F.col("u").bitwiseXOR(F.lit(1))
    linked = both.withColumn("k", key).join(least.select(key.alias("k"), "m"), "k")
    if larger_only:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): for each node that occurs in an edge, the smallest node reachable from it.

    Null ends and self links are ignored; repeated edges and either direction are allowed; no
    edges give an empty table.
    """
    start = edges.filter(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now, state = written(compact(start.distinct()), "edges"), None
    while state != (state := _digest(now)) and state[0]:
        before, now = now, written(compact(_round(_round(now, True), False)), "edges")
        dropped(before)
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
