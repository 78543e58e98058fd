"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link to a smaller one, and that one has none: then the roots are found."""
    ends = edges.select(F.col("b").alias("a")).distinct()
    return edges.groupBy("a").count().where(F.col("count") > 1).isEmpty() and edges.join(ends, "a", "left_semi").isEmpty()


def connected_components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long): root is the smallest node it reaches.

    Large-star and small-star steps in turn: every step relinks nodes to the smallest neighbour, so the
    count of rounds grows with the logarithm of the longest path, and no row ever holds a node's neighbours.
    Minimums are pre-aggregated before the shuffle; they are written before they are joined back, so that
    adaptive execution can split the rows of a node with very many links. Self links and repeated links are
    allowed; an empty input gives an empty result; rows with a null end are dropped.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, what)
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.save(large)
        least = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        small = scratch.save(small.where("a <> b").distinct())
        for old in (now, low, large, least):
            scratch.drop(old)
        now = small
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
