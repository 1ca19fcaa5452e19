"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stored, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (any ordered type). Returns node, component (its least node) for every node of an edge.

    Each round is two groupings by node with partial aggregation and two joins. What is joined is stored before, so that Spark
    may split the neighbours of a hub among tasks; no task holds a component, and the number of rounds grows with the logarithm
    of its size. Rounds lie in the shared folder, and each is deleted when the next is done.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    before = None
    for _ in range(most_rounds):
        for star in (_large_star, _small_star):
            least = stored(star(links), "links-least")
            after = stored(_joined(links, least, star is _large_star), "links")
            drop_stored(links, least)
            links = after
        state = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """a, m: the least of a node's neighbours and itself, for nodes that have greater neighbours. links: a > b."""
    down = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.select(F.col("b").alias("a")).distinct().join(down, "a", "left").select("a", F.coalesce("m", "a").alias("m"))


def _small_star(links: DataFrame) -> DataFrame:
    """a, m: the least of a node's lesser neighbours."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _joined(links: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """large: each greater neighbour of a node joined to the node's least. Else: a node and its lesser neighbours joined to it."""
    if large:
        moved = links.join(least.withColumnsRenamed({"a": "b", "m": "least"}), "b").select("a", F.col("least").alias("b"))
    else:
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()
