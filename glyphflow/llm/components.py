"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.frames import stored


def components(links: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node of its component, for every node of `links` (columns a, b).

    Each round hangs the larger neighbours of a node, then the smaller ones,
    under the smallest; when nothing moves every node hangs under its root. The
    rounds grow with the logarithm of the longest path. Links with a null or to
    the node itself do not matter; no node's links are gathered in one place.
    """
    edges = stored(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(_down(small.union(least.select("u", F.col("m").alias("v")))), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """A count and a sum that tell two sets of links apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
