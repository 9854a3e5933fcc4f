"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricweave.session import store


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root`` for every node of a link; the root is the smallest node reachable.

    Each round hangs the larger neighbours of every node below its smallest
    one, then the smaller ones; the links turn into stars in a number of rounds
    that grows with the logarithm of the nodes. A round is written to the
    shared folder, which cuts the lineage; only a count and a checksum reach
    the driver. Minima are formed on the map side, so a node with very many
    links is no single group anywhere.

    Links with a null end or of a node to itself carry nothing and are left
    out; repeated links count once.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = store(edges.where("u <> v").distinct(), "links")
    known = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == known or mark[0] == 0:
            break
        known = mark
        edges = store(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of those."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
