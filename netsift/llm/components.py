"""Connected components of an edge table, by alternating star contraction.

Each round links every node's larger neighbours to the smallest one it sees,
then its smaller neighbours; a logarithmic number of rounds ends in stars.
Rounds are aggregates and joins on (node, minimum) rows: no neighbour list is
ever collected, so a node may have any degree. Each round is a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (u > v). larger: each node's larger neighbours go to its minimum;
    else each node's smaller neighbours and the node itself do."""
    if larger:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(low, "u")
    moved = moved.where(F.col("v") > F.col("u")) if larger else moved
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node with an edge: label is the component's smallest
    node. ``edges`` (a, b) are long, never null; loops and repeats don't matter."""
    e = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = stored(e, "edges"), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before, e = now, stored(_star(_star(e, True), False), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
