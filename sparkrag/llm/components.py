"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import hot_keys, spread_join, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long): the smallest node it is linked with.

    Each round points every node to the smallest node within reach of one step, follows that pointer
    once more, and joins the nodes that point alike into one, so that the edges left shrink fast.
    Self-links make a node known. Null ends are left out. A node with many links, or that many point to,
    is spread over tasks.
    """
    edges = stored(edges.where("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    levels = []
    while left := edges.count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("links")).select(F.col("u").alias("node"), F.least("u", "v").alias("to"), "links")
        least = stored(least, "least")
        # No more nodes point to a node, and no more edges start or end there, than it has links, or one.
        hot = lambda name: hot_keys(least.select(F.col("node").alias(name), "links"), [name], "links", 2 * left)  # noqa: B023, E731
        jump = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
        level = stored(spread_join(least.select("node", "to"), jump, ["to"], hot("to")).select("node", F.col("next").alias("to")), "level")
        levels.append(level)
        a, b = level.select(F.col("node").alias("u"), F.col("to").alias("a")), level.select(F.col("node").alias("v"), F.col("to").alias("b"))
        moved = spread_join(spread_join(edges, a, ["u"], hot("u")).select("v", "a"), b, ["v"], hot("v"))
        edges = stored(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    up = levels[-1]
    for level in levels[-2:0:-1]:  # the small tables first
        up = level.join(up.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    if len(levels) > 1:
        up = spread_join(levels[0], up.select(F.col("node").alias("to"), F.col("to").alias("next")), ["to"], how="left").select("node", F.coalesce("next", "to").alias("to"))
    return up.withColumnRenamed("to", "component")
