"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import saved


def _mins(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour."""
    both = edges.union(edges.select("b", "a"))
    least = _mins(both).select("_a", F.least("m", "_a").alias("m"))
    joined = both.where("b > a").join(least, F.col("a") == F.col("_a"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_mins(down), F.col("a") == F.col("_a"))
    rows = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return rows.where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one lesser node at most, and on none if others hang on it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for nodes other than roots.

    ``links`` has columns a and b; rows with a null are left out, and an empty table
    gives an empty result. Sums of a node's links are combined before each
    exchange and a node with very many links is split by the adaptive join. Each
    round is written once; rounds grow with the logarithm of the longest chain, and links
    that are stars already take none.
    """
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = saved(down.distinct(), "links")
    while not _are_stars(edges):
        edges = saved(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
