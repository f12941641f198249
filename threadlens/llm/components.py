"""Connected components of a link table by alternating star contraction, as Spark joins.

Each round rewires every node to its smallest neighbour; the number of rounds grows with the
logarithm of the longest path. It runs until the edges stop changing, with no limit on rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import cut_lineage


EDGES_PER_TASK = 500_000


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return int(r["n"]), int(r["s"] or 0)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every linked id; the component is the smallest id in it."""
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where("u != v").distinct())
    state = _state(edges)
    while state[0]:
        # Few edges do not need a task for every shuffle partition.
        tasks = max(8, state[0] // EDGES_PER_TASK)
        # Every node hands its smallest neighbour to its larger ones.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks))
        large = cut_lineage(both.where("v > u").join(least, "u")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks))
        # Every node hands its smallest neighbour to its smaller ones and itself.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut_lineage(
            large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        new = _state(edges)
        if new == state:
            break
        state = new
    tops = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        tops.select(F.col("v").alias("id"), F.col("v").alias("component")))
