"""Connected components of a graph that may be far larger than one task: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for every end of an edge ``a``, ``b``.

    Every round rewires each node to the smallest node it knows, so the number of rounds grows with the logarithm of
    the longest path. Rounds are written to the shared folder, which also lets a lost executor resume from there.
    An empty table gives no rows; loops and repeated edges are harmless.
    """
    now = cut(_oriented(edges.select("a", "b")), "components")
    before = None
    while (state := _state(now)) != before:
        before = state
        now = cut(_small(_large(now)), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a")
    return near.select(F.col("b").alias("x"), "m").union(near.select(F.col("a").alias("x"), "m")).where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
