"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import hot_join, shared_dir


def _minimum(edges: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) with the least neighbour m of u; edges of a hub stay spread over tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return hot_join(edges, least, "u", "n", rows)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _minimum(both, 2 * rows).withColumn("m", F.least("u", "m"))
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    near = _minimum(edges, rows)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = near.select("u", F.col("m").alias("v"))
    return moved.union(kept).where("u > v").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(u, v) links of longs -> (node, root): root is the least node reachable. Isolated nodes are not listed.

    Rounds end when the edge table no longer changes: then every edge leads from a node to its root. Each round is
    checkpointed, so a lost executor costs one round at most. Null ends are dropped, self links too.
    """
    shared_dir(edges.sparkSession)

    def kept(df: DataFrame, rows: int) -> DataFrame:
        # As many partitions as the edges need: rounds over few edges are many small steps.
        return df.coalesce(rows // 50_000 + 1).checkpoint()

    now = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
           .where("u > v").distinct().checkpoint())
    rows, before = now.count(), None
    now = now.coalesce(rows // 50_000 + 1)
    for _ in range(limit):
        now = kept(_small_star(_large_star(now, rows), rows), rows)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before, rows = tuple(state), state[0]
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
