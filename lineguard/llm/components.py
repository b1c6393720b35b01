"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineguard.llm.common import few, held, stage


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of *links* (columns ``u`` and ``v``); root is the smallest node it reaches.

    Alternates the large-star and small-star steps: every node points its larger
    neighbours, then itself and its smaller ones, to the smallest node it sees. The
    tree flattens in a logarithmic number of rounds. No neighbour list is ever gathered:
    each step is a minimum with map-side combine and a join, and a node with very many
    links is a skewed join key that the adaptive planner splits. Loops and repeated links
    change nothing; links with a null end are ignored.

    A round never adds links, so few links stay in one partition in all rounds.
    """
    ends = links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    tree = stage(ends, "links")
    small = few(tree)

    def near(df: DataFrame) -> DataFrame:
        return held(df, small).hint("merge") if small else df  # a broadcast would be a job of its own

    tree = near(tree)
    while True:
        both = near(tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = near(both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tree = near(stage(near(rest.unionByName(first.withColumnRenamed("m", "b"))).distinct(), "links"))
        inner = tree.select(F.col("b").alias("a")).join(tree, "a", "left_semi")
        forks = tree.groupBy("a").count().where("count > 1").select("a")
        if near(inner.unionByName(forks)).isEmpty():
            break
    roots = tree.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return tree.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
