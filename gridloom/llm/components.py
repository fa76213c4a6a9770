"""Connected components of an edge table, by rounds of large-star and small-star, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges(a, b): root is the smallest id reachable. Nodes are longs.

    Stars are joined to their smallest neighbour by a hash aggregate and a join, never gathered in one task.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select("a", "b", "m")
        star = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialise(star)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
