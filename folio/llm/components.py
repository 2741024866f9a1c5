"""Connected components over edges, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) rows -> (node, component): every node of an edge with its component's least node.

    Alternating large and small stars: each round replaces the edges by edges to the least neighbour,
    O(log^2 n) rounds, each linear in the edges. The minimum of a hub's neighbours is pre-aggregated;
    the join with it reads written tables, so adaptive execution splits the hub. Each round is written
    to the shared folder. Self-loops give components of one node; rows with a null node are left out;
    direction and repeated rows don't matter; no edges give no rows.
    """
    e = edges.select("u", "v").where("u is not null and v is not null")
    loops = written(e.where("u = v").select(F.col("u").alias("node")).distinct(), "loops")
    e = written(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    found = components_of_pairs(e)
    return found.union(loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def components_of_pairs(e: DataFrame) -> DataFrame:
    """connected_components() of a written table of distinct (u, v) with u > v, which is released if it takes a round.

    The result reads written tables, its folio_uses."""
    while not _is_forest_of_stars(e):
        large = _star(e, larger_only=True)
        small = _star(large, larger_only=False)
        release(e, large)
        e = small
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.folio_uses = [e]
    return out


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, component) after components were linked: links is components_of_pairs() over pairs of components, or of
    nodes that parts doesn't have."""
    to = links.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = parts.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.union(links.join(parts.select("node"), "node", "left_anti").select("node", "component"))


def _is_forest_of_stars(e: DataFrame) -> bool:
    """True once each u has one v, and no v is itself some row's u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low = 1 and high = 1").isEmpty()


def _star(e: DataFrame, larger_only: bool) -> DataFrame:
    """e holds u > v. Large star: each larger neighbour of a node goes to the node's least neighbour or itself;
    small star: the node and its smaller neighbours go to the least of them."""
    if larger_only:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = written(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = written(out.where("u <> v").distinct(), "edges")
    release(least)
    return out
