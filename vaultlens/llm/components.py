"""Connected components of an edge list by a contraction and then large-star and small-star rounds, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's neighbours, the larger or the smaller ones, to the least node among it and all of those.

    A node's least neighbour is a partial aggregate and then one row to join, so that a hub's edges are never gathered.
    """
    both = edges if not large else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(least, "a")
    if large:
        out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of each node and its least neighbour, itself if that is less, and the edges between what remains when each node is taken for that neighbour.

    Neighbours stay neighbours or become one node, so nothing is torn apart; most edges of a dense family end in few nodes and go.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")))
    to = lambda c: up.select(F.col("a").alias(c), F.col("b").alias(f"{c}_up"))
    left = edges.join(to("a"), "a").join(to("b"), "b").filter("a_up <> b_up")
    return up, cut(left.select(F.greatest("a_up", "b_up").alias("a"), F.least("a_up", "b_up").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node. ``edges``: (a, b), any order."""
    up, now = _contracted(cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()))
    while not now.isEmpty():
        fresh = cut(_star(_star(now, True), False))
        same = fresh.count() == now.count() and fresh.join(now, ["a", "b"], "left_anti").isEmpty()
        now = fresh
        tidy(edges.sparkSession)
        if same:
            break
    # the least node of a component is taken for itself, so it is still the least of what remains
    root = now.select(F.col("a").alias("b"), F.col("b").alias("root"))
    return up.join(root, "b", "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("component"))
