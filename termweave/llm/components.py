"""Connected components of link tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import removed, written


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v of both directions' neighbours with least, the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return pairs.join(least, "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge and is no other's v: then v is the smallest node of u's component."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("end")).select("end.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1 and up > 0").count() == 0


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``links`` (columns a, b; any order, repeats and loops allowed).

    A large star links every larger neighbour of a node to the smallest one, a small star the node and its smaller
    neighbours; both keep the components, and their alternation ends in one star for each. Every round is two joins on
    the node whose minima are combined before the shuffle; rounds grow with the logarithm of a component's length. The
    links stay in tables in the shared folder. No links give no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # repeats stay until the end of the round: there are no more rows than edges
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
        small = _with_least(large)
        old, edges = edges, written(small.select(F.explode(F.array(F.struct("v", "least"), F.struct(F.col("u").alias("v"), "least"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.least").alias("v")).where("u <> v").distinct(), "stars")
        removed(old)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
