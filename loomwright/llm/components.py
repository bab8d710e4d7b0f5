"""Connected components of a link table by alternating large-star and small-star steps.

Each step is an aggregation and a join over links alone (never over all documents), makes no
more rows than it has links, and each round is written to the shared folder. The number of
rounds grows with the logarithm of the longest chain. A hub's links are never held as a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every node's neighbours (the larger ones, or else the smaller ones and itself) to its least neighbour.

    Links are distinct and have a > b, before and after: the least neighbour of a node is the
    least b that it has as an a, and a node without one is the least itself.
    """
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        out = links.join(least.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    else:
        # The link to the least neighbour stands for the node's own; all others move their end.
        out = links.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.distinct()


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """links (a, b) in, (node, root) out: the least node of each component, for every node with a link.

    An empty link table gives an empty result; links from a node to itself and repeated
    links change nothing.
    """
    links = work.keep(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    sign = None
    for k in range(1, MOST_ROUNDS):
        new = work.keep(_star(_star(links, True), False), f"{name}-{k}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        work.drop(f"{name}-{k - 1}")
        links = new
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
