"""Connected components of a graph by alternating stars, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.session import durable


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of all nodes of ``edges`` (a, b) but the roots, the smallest nodes of their components.

    Each round links the larger neighbours of every node to its smallest one, then the
    smaller neighbours to their smallest, until only stars are left. The rounds are
    written, so a lost executor costs no earlier round. Minima are combined before they
    are shuffled; nodes with many neighbours meet theirs in joins that Spark can split.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    while not _stars(now):
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).union(now.select("y", "x"))
        lowest = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = durable(both.join(lowest, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct())
        lowest = durable(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(lowest, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = durable(small.union(lowest).distinct())
    return now.select(F.col("x").alias("node"), F.col("y").alias("root"))


def _stars(now: DataFrame) -> bool:
    """Whether every x has one y, which is no x itself."""
    several = now.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
    inner = now.select(F.col("y").alias("x")).join(now.select(F.col("x").alias("x_")), F.col("x") == F.col("x_"), "left_semi")
    return several.isEmpty() and inner.isEmpty()
