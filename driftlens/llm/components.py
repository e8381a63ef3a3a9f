"""Connected components of a table of links, by alternating star steps.

Each step replaces links by links to smaller neighbours, found by grouped minima and joins, until nothing changes;
every round is written, so a lost executor costs a re-read. The number of rounds grows with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.staging import stage


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a"), F.least("a", "least").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets a link to the node's least neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get links to the least of them."""
    least = _least(links)
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b")


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link, to a root that has none."""
    chained = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    twice = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    return chained.select("a").unionByName(twice).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that is not itself the least of its component; ``links`` has (a, b)."""
    down = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while not _settled(down):
        large = stage(_large_star(down).where("a <> b").distinct(), "links")
        down = stage(_small_star(large).distinct(), "links")
    return down.select(F.col("a").alias("node"), F.col("b").alias("root"))
