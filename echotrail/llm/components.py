"""Connected components of an edge table, fully distributed.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Each step is a partial-aggregated
minimum per node and a join back, so a node with many neighbours needs no
task that holds them all; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def connected_components(edges: DataFrame, work: Work, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the least id reachable.

    Self-loops and null ends are ignored, repeated edges don't matter, an
    empty table gives an empty result.
    """
    now = work.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0"
    )
    for i in range(1, max_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        # large star: every larger neighbour of u moves to u's least neighbour
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        lowest = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("w").alias("v")), F.struct("u", F.col("w").alias("v")))).alias("e")
        )
        after = work.save(small.select("e.u", "e.v").filter("u <> v").distinct(), f"{name}_{i}")
        # done when every node points to a root: then each u occurs once and no v is a u
        state = after.agg(F.count("*").alias("n"), F.countDistinct("u").alias("nodes")).first()
        stars = state.n == state.nodes and after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        work.drop(f"{name}_{i - 1}")
        now = after
        if stars:
            break
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
