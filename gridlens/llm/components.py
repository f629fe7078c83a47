"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.session import scratch, stage


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _checksum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def connected_components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node with an edge to another node.

    Each round moves edges towards the smallest neighbour and is stored in the shared folder. A hub
    costs one row per neighbour, and its minimum is formed before rows are exchanged. Null nodes have
    no edges.
    """
    with scratch(edges.sparkSession):
        e = stage(_rounds(edges, a, b, label), label, outer=True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def _rounds(edges: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """The edges as stars: every node with the smallest one of its component."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stage(e, label)
    before = _checksum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both).withColumn("m", F.least("u", "m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = _least(large)
        small = large.join(m, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = stage(small.where("u <> v").distinct(), label)
        after = _checksum(e)
        if after == before:
            break
        before = after
    return e
