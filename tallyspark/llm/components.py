"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps: each is one aggregate (the least
neighbour) and one join, so no neighbourhood is ever collected, and a node
with very many edges is an ordinary skewed join key. Each step's edges are
written, and the loop ends when they stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch


def _digest(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` has long columns a and b. One row (node, root) for every node
    that has an edge; root is the least node of the component (for the root
    itself too). Self-loops and repeated edges do no harm."""
    edges = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(edges, f"{name}_0")
    before, step = _digest(edges), 0
    while before[0]:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges from u to smaller nodes only: u is larger than its v from here on
        large = scratch.write(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
                              .where("u <> v").distinct(), f"{name}_{step}_large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.write(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(),
                              f"{name}_{step}")
        after = _digest(edges)
        scratch.drop(f"{name}_{step - 1}", f"{name}_{step}_large")
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.join(edges.select(F.col("u").alias("node")), "node", "left_anti").select(
            "node", F.col("node").alias("root")))
