"""Connected components of a link table by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, joined, saved


def components(links: DataFrame) -> DataFrame:
    """(node, component), written, for every node of the links (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps: every node hands its neighbours the smallest one it knows, until each
    node links to one that links to no smaller one. Rounds grow with the logarithm of the longest path. Each step is
    written to the shared folder, and the table before it deleted. A node with very many links is split among tasks by
    Spark's adaptive skew joins.
    """
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = joined(both, smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct(), "large")
        small = joined(large, large.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = saved(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        dropped(now, large)
        now = new
    out = saved(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()), "components")
    dropped(now)
    return out


def _stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and those that have one are nobody's smaller neighbour."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.max("down").alias("downs")).where("ups > 1 or ups > 0 and downs > 0").isEmpty()
