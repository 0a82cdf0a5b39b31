"""Connected components of a graph given as a table of edges.

Alternating star contraction: in turn every node hands its larger neighbours, then its smaller ones,
to the least node it knows. Each round is joins and pre-aggregated minima on tables in the shared
folder; neither links nor components come to the driver, only two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool, tag: str) -> DataFrame:
    """One star step on edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # Written, so that the join below is one between two exchanges, which can be split where a hub is hot.
    least = written(both.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-least").withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return written(out.where(F.col("u") > F.col("v")).distinct(), tag)


def _sum(edges: DataFrame) -> tuple:
    """Two numbers that differ between different sets of edges; neither can overflow."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns ``id`` and ``component`` (the least id in it) of all nodes that are not least themselves.

    ``edges`` has columns a and b; self-loops, repeats and either direction do no harm, rows with a null
    are left out. Nodes that are the least of their component, or have no edge, are not in the result.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _sum(now)
    if not before[0]:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for k in range(most_rounds):
        now = _star(_star(now, True, f"large-{k}"), False, f"small-{k}")
        after = _sum(now)
        if after == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
