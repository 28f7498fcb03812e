"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """Each (u, v) with m = the least of u and its neighbours.  The minimum is aggregated before
    the join, which Spark splits where a node has very many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("n")).drop("n")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _neighbour_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _neighbour_minimum(down)
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every node of an undirected edge table; component is its least node.

    Alternates large-star and small-star until the edges are stars around the least nodes;
    rounds grow with the logarithm of the number of nodes.  Loops and null ends give no edge,
    but a node with only a loop is returned as its own component.
    """
    named = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    state = cut_lineage(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = state.where("u = v")
    state = state.where("u <> v")
    mark = None
    while True:
        state = cut_lineage(_small_star(_large_star(state)).where("u <> v"))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    heads = state.select(F.col("v").alias("id"), F.col("v").alias("component")).unionByName(loops.select(F.col("u").alias("id"), F.col("u").alias("component")))
    return stars.unionByName(heads).groupBy("id").agg(F.min("component").alias("component"))


def forest_roots(parents: DataFrame, child: str = "dst", parent: str = "src") -> DataFrame:
    """(id, component) of every child in a table that gives each child one parent, without cycles: component is the root above it.

    Steps up double, so a round is one join and rounds grow with the logarithm of the depth: cheaper than
    connected_components where links point to a centre."""
    state = cut_lineage(parents.select(F.col(child).alias("id"), F.col(parent).alias("up")))
    while True:
        above = state.select(F.col("id").alias("at"), F.col("up").alias("next"))
        state = cut_lineage(state.join(above, F.col("up") == F.col("at"), "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("id", F.col("up").alias("component"))
