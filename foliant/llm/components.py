"""Connected components by alternating large-star and small-star rounds over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, join_by_key


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's least neighbour, itself included."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_by_key(near.where("b > a"), least, "a", "n", 2 * total).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    near = join_by_key(down, least, "a", "n", total).select(F.col("m").alias("a"), "b").where("a <> b")
    return near.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) for every id in links (a, b): comp is the least id that it reaches.

    No round gathers a node's neighbours; only counts and a checksum of the links come to the driver. Nulls are not
    expected; a link of a node with itself is ignored; an empty table gives an empty result.
    """
    now = scratch.table(links.select("a", "b").where("a <> b").distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = mark(now)
    while was[0]:
        large = scratch.table(_large_star(now, was[0]))
        after = scratch.table(_small_star(large, large.count()))
        scratch.drop(now, large)
        now, new = after, mark(after)
        if new == was:
            break
        was = new
    return scratch.table(now.select(F.col("b").alias("id"), F.col("a").alias("comp")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct()))
