"""Connected components over an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Staged


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one other that points to none: nothing is left to do."""
    pointing = edges.groupBy("u").agg(F.count("*").alias("n"))
    twice = pointing.where("n > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).distinct().join(pointing.select("u"), "u", "left_semi")
    return twice.unionByName(chained).isEmpty()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step links every node to the smallest
    of its neighbours, until all components are stars; the number of rounds grows with the logarithm of the longest
    chain. Minima are combined before the shuffle and written before they are joined, so that the rows of a node with
    very many neighbours can be split; each round's tables are deleted when the next is written.
    """
    held = Staged(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(held.df):
        both = held.df.unionByName(held.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Staged(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = Staged(spark, both.join(least.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        held.drop()
        least.drop()
        least = Staged(spark, large.df.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.df.join(least.df, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.df.select("u", F.col("m").alias("v")))
        held = Staged(spark, small.distinct(), "edges")
        least.drop()
        large.drop()
    stars = held.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(held.df.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
