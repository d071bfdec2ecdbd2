"""Connected components as alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.session import cut


def _star(edges: DataFrame, by: list[str], larger: bool) -> DataFrame:
    """One contraction. Neighbours hang below the smallest node of each neighbourhood (large star: the larger ones only)."""
    # Every edge leads down, so the condition holds for all; it stands so that no checkpoint is a part of the union itself.
    near = edges.where("u > v").select(*by, "u", "v")
    if larger:
        near = near.union(edges.where("u > v").select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
    joined = near.join(least, [*by, "u"])
    if larger:
        out = joined.where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(*by, F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(*by, "u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, by: list[str] | None = None, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, or of one for each value of the columns `by`.

    edges: (by, u, v), u and v integers. Returns (by, node, component) for each node that has an edge to another one;
    component is the smallest node that can be reached. Self loops, null ends and repeated edges are ignored. Each round
    costs combined minima and joins by node, so no component is ever one group, and is written to the checkpoint folder,
    so that a lost executor repeats one round at most. Raises when max_rounds do not suffice (rounds grow with the
    logarithm of the size).
    """
    by = by or []
    now = cut(edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    settled = now.isEmpty()
    for _ in range(max_rounds):
        if settled:
            break
        after = cut(_star(_star(now, by, True), by, False))
        # Stars: no node hangs below two, nor below one and above another.
        places = after.select(*by, F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(after.select(*by, "v", F.lit(0), F.lit(1)))
        settled = places.groupBy(*by, "node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1 and below > 0").isEmpty()
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(*by, F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct())
