"""Connected components of a graph given as a table of links, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketclime.session import cut_lineage


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of ``links`` (a, b), both ends of one orderable type.

    Alternating large-star and small-star steps: a node links its larger
    neighbours, then its smaller ones, to the smallest among them, until every
    node points at its component's smallest. Each step is a map-side combined
    minimum per node and an equi-join, so a node with very many links is summed
    up before it moves. Null ends are ignored.
    """
    edges = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    # always larger node first
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = cut_lineage(small.union(least.select("a", F.col("least").alias("b"))).distinct(), "links")
        # done when every node has one link and no end of a link has one itself
        tops = small.select(F.col("b").alias("a")).distinct()
        moved = small.groupBy("a").count().filter("count > 1").select("a").union(small.join(tops, "a", "left_semi").select("a"))
        edges = small
        if moved.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())
