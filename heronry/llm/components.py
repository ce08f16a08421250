"""Connected components of an edge table, without ever holding it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forgotten, settled, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large star: each node's larger neighbours go to its smallest one. Small star:
    the node and its smaller neighbours do. The smallest neighbour comes from an aggregate with map-side
    sums and a join, which adaptive execution can split, so that a hub isn't one task's load."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        pairs = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        pairs = edges.join(least, F.col("u") == F.col("k")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return pairs.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """edges (u, v) of any order with repeats and loops -> (node, component), component being the
    smallest node it is connected with. Nodes without an edge to another node are not listed.

    Alternates large and small stars, which takes a logarithmic number of rounds in practice, and
    writes the edges to the shared folder after each round."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not state["n"] or seen == (state["n"], state["x"]):
            break
        seen = (state["n"], state["x"])
        before, now = now, written(_stars(_stars(now, True), False), tag)
        forgotten(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # All edges are now from a node to its component's smallest node, which is in its own component too.
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return settled(named.unionByName(named.select(F.col("component").alias("node"), "component").distinct()), tag, now)
