"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablesight.functions.storage import store


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is named by its smallest node.

    Each round a node takes the smallest name among its neighbours and then the name of that name, until
    nothing changes. Names are aggregated before the shuffle, so a node with very many links is no hot key.
    """
    both = store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .where(F.col("a") != F.col("b")).distinct())
    named = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = (both.join(named, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
                .join(named, F.col("a") == F.col("node")).select("node", F.least("near", "component").alias("next"), "component"))
        jump = named.select(F.col("node").alias("next"), F.col("component").alias("far"))
        after = store(near.join(jump, "next").select("node", F.least("next", "far").alias("after"), "component"))
        changed = after.where(F.col("after") != F.col("component")).limit(1).count()
        named = after.select("node", F.col("after").alias("component"))
        if not changed:
            return named
