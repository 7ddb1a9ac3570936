"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (pre-aggregated before its shuffle) joined back to the edges; a
node with very many edges makes a skewed join, which adaptive execution splits.  Edge lists are
written to the shared folder after each round, so that the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b: link neighbours of each node to the least one."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = (
            edges.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        )
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100, rows: int | None = None) -> DataFrame:
    """Components of the graph with edges (a long, b long): rows (node, component), component the
    least node reachable.  Nodes without edges, self-loops and null ends don't appear; repeated
    and reversed edges count once.  rows: edges at most, where known.  Raises RuntimeError if
    max_rounds don't suffice."""
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows
    )
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = state(now)
    for _ in range(max_rounds):
        if not before["n"]:
            break
        earlier, now = now, materialise(_stars(_stars(now, True), False), "edges", 2 * before["n"])
        discard(earlier)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge leads from a node to its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
