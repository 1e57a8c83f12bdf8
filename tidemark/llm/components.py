"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node sends the least node of its neighbourhood to its larger, or to its smaller, neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if larger else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's least node) of every node of the undirected edges a-b, which may repeat."""
    now = durable(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        now = durable(_stars(_stars(now, larger=True), larger=False).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def follow(steps: DataFrame, turns: int = 3) -> DataFrame:
    """node and root, where root is reached from the node in up to 2 ** turns of the ``steps`` node -> root, which have no cycle.

    Nodes of one root are connected, but a component may have several roots: enough to leave out known connections.
    """
    now = steps.select("node", "root")
    for _ in range(turns):
        after = now.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        now = durable(now.join(after, "root", "left").select("node", F.coalesce("__next", "root").alias("root")))
    return now
