"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an edge list (a, b) of longs with the least node it reaches.

    Neither a component nor a node's neighbours are ever gathered: a step is a minimum by
    partial aggregation and a join, so one component may hold any share of the nodes. Each
    step is checkpointed; the number of steps grows with the logarithm of the nodes.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        if (then := mark(now)) == seen:
            return now.toDF("node", "root").union(now.select("b", "b").distinct())
        seen = then
