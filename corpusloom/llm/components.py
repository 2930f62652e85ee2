"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node.

    Alternating large-star and small-star steps (Kiveris and others 2014): each round links
    the neighbours of a node to the least of them, with joins and minima only, so a
    node with very many neighbours is a group of an aggregation, never a list in memory.
    Each round ends in a written table; it stops when a round changes nothing.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both if large else both.where("b < a")
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = around.join(least, "a")
        moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    for _ in range(most_rounds):
        now = cut(star(star(now, True), False), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
