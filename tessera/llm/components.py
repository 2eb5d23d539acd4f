"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is a minimum per node and a join, so nothing is gathered: a node with very many neighbours is pre-aggregated, and
its join is one that Spark may split. Rounds cut the lineage with a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours larger than the node are linked to the least of node and neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours smaller than the node, and the node, are linked to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From u, v (long): node, component (least node reachable), for nodes with an edge to another node."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = written(now, "edges")
    mark = None
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)), "edges")
        row = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if row == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = row
    raise RuntimeError(f"no fixed point within {rounds} rounds")
