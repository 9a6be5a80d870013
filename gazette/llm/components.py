"""Connected components of an edge list by alternating large-star and small-star rounds.

Neighbourhoods are never gathered: each round needs only the least neighbour of a node, a sum-like
aggregation that combines before the shuffle, and a join back to the edges. Every round is written to the shared
folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Links each node's neighbours (greater ones if large, else lesser ones) to its least neighbour."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = near.join(least, near["u"] == least["c"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (its component's least node) of every node with an edge; edges: u, v (long, in any order)."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(most_rounds):
        now = materialize(_star(materialize(_star(now, True), "edges"), False), "edges")
        if (new := mark(now)) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
