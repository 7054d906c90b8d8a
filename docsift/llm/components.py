"""Connected components of a link table, by large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round points larger neighbours at the smallest neighbour (large star), then all but the larger
    at the smallest (small star), until the edges stay the same. Minima are combined before they are
    shuffled, and a hub's edges join one row, which adaptive execution can split. Rounds are tables.
    """
    spark = edges.sparkSession
    now = table(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = table(spark, large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = table(spark, new, "small-star")
        was, state, now = state, _state(new), new
        if was == state:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Size and order-free digest of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
