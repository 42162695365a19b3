"""Connected components by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of edges (u, v): component is the smallest node that links reach.

    Each round hangs all larger neighbours, then all smaller ones, on a node's smallest
    neighbour; when nothing changes, every component is a star around its smallest
    node. Rounds grow with the logarithm of the longest path. Each is a written
    table, so lineage stays short. No edges: no rows. Loops and repeated edges do no harm.
    """
    at = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct(), "cc")
    mark = _mark(at)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = at.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(at.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        hung = large.join(lower, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        at = materialise(hung.unionByName(lower.select("v", F.col("m").alias("u"))).distinct(), "cc")
        before, mark = mark, _mark(at)
        if mark == before:
            break
    pairs = at.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    roots = at.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    return r[0], r[1] or 0
