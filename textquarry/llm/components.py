"""Connected components of a graph given by its edges, in rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _toward_smallest(pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Each pair (u, v) becomes (v, m), m the smallest of u and its neighbours."""
    smallest = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step (Kiveris et al. 2014). Edges have u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = both.filter(F.col("v") > F.col("u"))
    edges = _toward_smallest(larger, both).filter(F.col("u") > F.col("v")).distinct()
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(smallest, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(smallest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for each node of the edges (a, b) that is not itself the smallest of its component.

    The number of edges never grows, and a round keeps the graph's components. It ends when a round
    changes nothing: every node then points to its root.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, now = found, stored(_round(now), "edges")
