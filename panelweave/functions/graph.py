"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.lineage import materialize

_MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    h: Column = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """``(node, component)`` for every node of an edge list; ``component`` is the least node reachable.

    Nodes are any ordered type. Self-loops and repeated edges are allowed; null ends are dropped. Neighbourhoods are
    only aggregated and joined, never gathered into one value. Each round writes its edge list to the shared folder, and
    the rounds end when a round leaves the list as it was; their number grows with the logarithm of the node count.
    """
    given = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct(), "given-edges")
    now = given.where("u <> v")
    before = None
    for _ in range(_MAX_ROUNDS):
        if (state := _state(now)) == before:
            break
        before = state
        if not state[0]:
            break
        now = materialize(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {_MAX_ROUNDS} rounds")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )
