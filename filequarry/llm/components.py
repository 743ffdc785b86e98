"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filequarry.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable, for each id in ``edges`` (a, b).

    Each round is two aggregations with joins back, so a node with many links is split like any
    skewed join; the edge list is written to the shared folder after each round and the rounds
    end when it consists of stars (a logarithmic number of them on graphs met in practice).
    """
    edges = written(_ordered(edges), "edges")
    while not _only_stars(edges):
        edges = written(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))


def merged(part: DataFrame, links: DataFrame) -> DataFrame:
    """``part`` (id, component) after further ``links`` (a, b), a written table.

    Components are contracted to their smallest id first, so only the new links are iterated on.
    """
    if links.isEmpty():
        return part
    for end in ("a", "b"):
        root = part.select(F.col("id").alias(end), F.col("component").alias("root"))
        links = links.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    more = written(components(links), "merged")
    now = part.join(more.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left")
    now = now.select("id", F.coalesce("further", "component").alias("component"))
    return now.unionByName(more.join(part, "id", "left_anti").select("id", "component"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, the larger id first."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Each larger end has one link and is nobody's smaller end."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    open_ = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)")
    return open_.agg(F.count("*")).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _ordered(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return _ordered(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))
