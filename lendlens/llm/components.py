"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.session import settle


def _stars(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Links every neighbour of a node to the smallest node around it.

    The minimum is a hash aggregate and meets the neighbours again by a join, so that a node with very
    many neighbours is combined on the map side and split at run time, not gathered.
    """
    lows = edges.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    lows = lows.withColumnRenamed("a", "node")
    met = edges.join(lows, edges["a"] == lows["node"])
    kept = met.where("b <= a") if smaller_only else met.where("b > a")
    out = kept.select(F.col("b").alias("x"), F.col("low").alias("y"))
    if smaller_only:
        out = out.union(lows.select(F.col("node").alias("x"), F.col("low").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) ``edges``; the root is the smallest node reachable.

    Large-star and small-star rounds alternate until nothing changes, a number of rounds that grows with the
    logarithm of the nodes. Each round is written to the checkpoint folder, which cuts the lineage. Only the
    count and a checksum of the edges reach the driver. Loops and null ends are ignored.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = settle(links)
    state = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = settle(_stars(both, smaller_only=False))
        links = settle(_stars(large, smaller_only=True))
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), F.col("root"))).distinct()
