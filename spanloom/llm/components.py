"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import drop_stored, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node of each component, for every node with an edge.

    Edges stay in the executors; each round is written to the shared folder, so lineage stays short and lost
    executors cost one round. Self loops and repeated edges do no harm; no edges give an empty table.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct(), "star")
    before = None
    for _ in range(rounds):
        # Large star: each node's larger neighbours are hung on its smallest neighbour.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node's smaller neighbours, and itself, are hung on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = stored(small, "star")
        seal = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(now)
        now = after
        if seal == before:
            break
        before = seal
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
