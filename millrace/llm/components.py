"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all go to the smallest of them (here v < u)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v long): the smallest node reachable.

    Both stars need only a minimum per node and an equi-join, so a hub is
    pre-aggregated before the shuffle and its edges can be split by the skew join.
    Self-loops, repeated edges and edges with a null end are ignored; no edges give
    no rows.  Each step is written to the shared folder and the step before deleted;
    the count and hash sum of the edges tell when nothing moves any more.  The result
    is written too, for the caller to ``forget``.
    """
    tidy = lambda e: e.where("u <> v").distinct()
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, seen = materialize(tidy(edges), label), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen, before = now, edges
        edges = materialize(tidy(_small_star(tidy(_large_star(edges)))), label)
        forget(before)
    grown = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = materialize(grown.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), label)
    forget(edges)
    return found
