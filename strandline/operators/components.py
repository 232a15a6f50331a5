"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.scratch import Scratch


def _least(edges: DataFrame, node: str) -> DataFrame:
    return edges.groupBy(node).agg(F.min("other").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    least = _least(both, "node").select("node", F.least("node", "least").alias("least"))
    return both.join(least, "node").where("other > node").select(F.col("other").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other"))
    joined = down.join(_least(down, "node"), "node")
    # the node's own tie comes with its rows
    out = joined.select(F.explode(F.array(F.struct(F.col("other").alias("u"), F.col("least").alias("v")), F.struct(F.col("node").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table: equal marks mean that nothing changed."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; a component is named by its least node.

    Edges may repeat, point either way or tie a node to itself (such a node alone stays out).  The
    steps alternate until the edge table is a set of stars; each step keeps one row per edge at most,
    aggregates before it shuffles, and writes its result to the shared folder, so that lineage and
    memory stay bounded whatever the size of a component.  An empty table gives an empty result.
    """
    edges = scratch.save(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    mark = _mark(edges)
    while True:
        large = scratch.save(_large_star(edges))
        small = scratch.save(_small_star(large))
        scratch.drop(edges, large)
        new = _mark(small)
        edges = small
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
