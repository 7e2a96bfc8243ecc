"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.session import drop_tables, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b, longs); root is the
    smallest node of the component.

    Large star: each node's larger neighbours are tied to its smallest
    neighbour.  Small star: its smaller neighbours are.  Rounds are about
    logarithmic in the longest path; the edge table shrinks to stars around the
    roots.  Every round is a written table; minima are combined map-side before
    they are joined back, so a hub is no group in one task.  A round's tables go when
    the next one's edges are written; the last edges stay, for the result.
    """
    now = materialize(edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m"))
                            .select("a", F.least("a", "m").alias("m")))
        least_before = least
        large = materialize(both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = least.select("a", F.col("m").alias("b")).unionByName(tied)
        before = now
        now = materialize(small.where("a != b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        drop_tables(before, least_before, large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select("b").distinct().select(F.col("b").alias("a"), "b")
    return now.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))
