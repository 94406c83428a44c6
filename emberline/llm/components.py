"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (``u, v``); a component is its least node.

    A large-star step ties a node's greater neighbours to its least neighbour, a small-star
    step ties the lesser ones and the node itself.  Both are a minimum per node, summed up
    before the shuffle, and a join; a node with very many edges is never gathered.  The
    steps alternate until a round changes no edge; each round is written out.
    """
    current = stored(_directed(edges.select("u", "v")), "edges")
    state = _state(current)
    while state[0]:
        current = stored(_small_star(_large_star(current)), "edges")
        before, state = state, _state(current)
        if before == state:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from its greater to its lesser end."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _directed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lesser = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _directed(lesser.unionByName(least.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
