"""Connected components of an undirected graph given as edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def connected_components(work: Workspace, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge (u, v); root is the smallest reachable node, itself included.

    Large-star and small-star rounds alternate until all components are stars; then each edge is (node, root).
    Minima are aggregates that combine before the shuffle, and the joins back are inner equi-joins, which
    adaptive execution splits when one node has very many edges. Nulls and loops are ignored; no edge, no row.
    Each round is a table in the shared folder, so that a lost executor costs one round.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = work.table(e, "edges")

    def settled(df: DataFrame) -> bool:
        """Whether every node has one edge down at most, and then none up."""
        ends = df.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("down")))).alias("e")).select("e.*")
        loose = ends.groupBy("n").agg(F.sum("down").alias("d"), F.count("*").alias("c")).where("d > 1 or d = 1 and c > 1")
        return loose.isEmpty()

    for _ in range(most_rounds):
        if settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        new = work.table(small, "edges")
        work.drop(e)
        e = new
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
