"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations with map-side partials and a join that Spark can split where a node is hot; the edge
table is written to the shared folder after each round, so a lost executor costs one round. Rounds end when every node
is the centre of a star or hangs on one centre alone, which is counted, and then a star is a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: each node hands its larger neighbours to its least one; small: its smaller ones."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    least = least.select("node", F.least("node", "m").alias("m"))
    joined = seen.join(least, seen["u"] == least["node"])
    moved = joined.where(F.col("v") > F.col("u")) if large else joined
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node that has a smaller neighbour has one such, and no larger one."""
    ends = F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    by_node = edges.select(ends).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return by_node.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1))).isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the least node that can be reached, for each node of an edge (a, b); loops are ignored."""
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now = nodes.where("u > v")
    for turn in range(max_rounds):
        if _are_stars(now):
            break
        after = written(_star(_star(now, True), False), "stars")
        if turn:
            removed(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    labelled = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    all_nodes = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return all_nodes.join(labelled, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
