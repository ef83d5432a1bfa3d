"""Connected components of edge tables, by hooking and pointer jumping on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "union") -> DataFrame:
    """(id, component) of every id that is not the smallest of its component.

    ``edges`` has longs (a, b).  In each round every id hooks on to its smallest neighbour, the
    chains are shortened to their roots, and the edges move up to the roots; a round at least
    halves the ids left in a component, and groups that hang together by one member need one.
    Only minima are aggregated, so a member with very many edges costs no more than they do.
    """
    turned = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = scratch.keep(turned.filter("a < b").distinct(), f"{name}-edges-0")
    labels = None
    k = 0
    while not live.isEmpty():
        up = scratch.keep(live.groupBy("b").agg(F.min("a").alias("a")), f"{name}-up-{k}-0")
        jump = 0
        while True:
            over = up.select(F.col("b").alias("a"), F.col("a").alias("over"))
            if up.join(over, "a", "left_semi").isEmpty():
                break
            jump += 1
            up = scratch.keep(up.join(over, "a", "left").select(
                "b", F.coalesce("over", "a").alias("a")), f"{name}-up-{k}-{jump}")
        if labels is None:
            labels = up.select(F.col("b").alias("id"), F.col("a").alias("component"))
        else:
            root = up.select(F.col("b").alias("component"), F.col("a").alias("root"))
            older = labels.join(root, "component", "left").select(
                "id", F.coalesce("root", "component").alias("component"))
            labels = scratch.keep(older.union(up.select("b", "a")), f"{name}-labels-{k}")
        at_a = up.select(F.col("b").alias("a"), F.col("a").alias("ra"))
        at_b = up.select("b", F.col("a").alias("rb"))
        moved = live.join(at_a, "a", "left").join(at_b, "b").select(
            F.coalesce("ra", "a").alias("x"), F.col("rb").alias("y")).filter("x <> y")
        k += 1
        live = scratch.keep(moved.select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges-{k}")
    if labels is None:
        return edges.select(F.col("a").cast("long").alias("id"), F.col("b").cast("long").alias("component")).limit(0)
    return labels
