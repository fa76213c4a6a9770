"""Communities by modularity: nodes move between clusters, clusters become the nodes of a smaller graph, and so on up a hierarchy."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import by_cluster_size
from .lineage import cut, forget

#: Rise in modularity below which a round counts as none: a fixed value.
LEAST_RISE = 1e-7


class Level(NamedTuple):
    """A level's clusters: (id, cluster) of every node of the first graph, their modularity, and the rounds of moves that led there."""

    clusters: DataFrame
    modularity: float
    rounds: int


def _undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a <= b, parallel edges and both directions summed; loops stay."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("w").cast("double").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 0")


def _ends(pairs: DataFrame) -> DataFrame:
    """(id, other, w): each pair from both of its ends, a loop twice."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x"), "w").select("x.id", "x.other", "w")


def quality(pairs: DataFrame, label: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (id, c): for each cluster, resolution times its share of weight inside, less the squared share of its ends."""
    both = pairs.join(label.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    one = F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), 2 * F.col("w")).otherwise(F.lit(0.0)).alias("inside"), F.col("w").alias("ends")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inside"), F.col("w").alias("ends")))
    by = both.select(F.explode(one).alias("x")).groupBy("x.c").agg(F.sum("x.inside").alias("inside"), F.sum("x.ends").alias("ends"))
    row = by.agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"), F.sum(F.col("ends") * F.col("ends")).alias("squares")).first()
    return resolution * row["inside"] / row["ends"] - row["squares"] / row["ends"] ** 2 if row["ends"] else 0.0


def _proposals(ends: DataFrame, strength: DataFrame, label: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """(id, c, to, rise): for each node that would raise the modularity by moving alone, its best neighbouring cluster and the rise."""
    placed = label.join(strength, "id")
    totals = placed.groupBy("c").agg(F.sum("k").alias("total"))
    near = ends.where("id <> other").join(label.select(F.col("id").alias("other"), F.col("c").alias("to")), "other").groupBy("id", "to").agg(F.sum("w").alias("into"))
    # The own cluster is an option even where no neighbour is in it: its value is the one to beat.
    options = near.unionByName(label.select("id", F.col("c").alias("to"), F.lit(0.0).alias("into"))).groupBy("id", "to").agg(F.sum("into").alias("into"))
    valued = options.join(placed, "id").join(totals.withColumnRenamed("c", "to"), "to")
    rest = F.col("total") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
    valued = valued.select("id", "c", "to", (resolution * F.col("into") - F.col("k") * rest / two_m).alias("value"))
    best = valued.groupBy("id", "c").agg(F.max(F.when(F.col("to") == F.col("c"), F.col("value"))).alias("stay"), F.max_by(F.struct("to", "value"), F.struct(F.round("value", 9), -F.col("to"))).alias("best"))
    return best.select("id", "c", F.col("best.to").alias("to"), (2 * (F.col("best.value") - F.col("stay")) / two_m).alias("rise")).where((F.col("to") != F.col("c")) & (F.col("rise") > 1e-12))


def _apart(moves: DataFrame) -> DataFrame:
    """Moves no two of which touch one cluster, the best of all among them, so that their rises add up."""
    touched = moves.select("id", "rise", F.explode(F.array("c", "to")).alias("cluster"))
    first = touched.groupBy("cluster").agg(F.max_by("id", F.struct("rise", -F.col("id"))).alias("id"))
    return moves.join(first.groupBy("id").agg(F.count("*").alias("n")).where("n = 2").select("id"), "id", "left_semi")


def _settled(pairs: DataFrame, resolution: float, most: int) -> tuple[DataFrame, float, int]:
    """Labels (id, c) after rounds of moves that each raise the modularity, the modularity, and how many rounds there were.

    In a round half of the nodes, drawn by a hash, make their best move together. Should that not raise the modularity, the round makes only moves that do not touch each other.
    """
    ends = cut(_ends(pairs))
    strength = cut(ends.groupBy("id").agg(F.sum("w").alias("k")))
    two_m = strength.agg(F.sum("k")).first()[0]
    label = cut(strength.select("id", F.col("id").alias("c")))
    now, idle = quality(pairs, label, resolution), 0
    for r in range(most):
        moves = cut(_proposals(ends, strength, label, two_m, resolution))
        if moves.isEmpty():
            forget(moves, ends, strength)
            return label, now, r
        half = moves.where(F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2)
        for chosen in (half, _apart(moves)):
            to = chosen.select("id", "to")
            moved = cut(label.join(to, "id", "left").select("id", F.coalesce("to", "c").alias("c")))
            after = quality(pairs, moved, resolution)
            if after - now >= LEAST_RISE:
                forget(label)
                label, now = moved, after
                break
            forget(moved)
        forget(moves)
        if label is not moved:
            forget(ends, strength)
            return label, now, r
    raise RuntimeError(f"clusters still move after {most} rounds")


def hierarchy(edges: DataFrame, resolution: float = 1.0, most: int = 1000) -> list[Level]:
    """Levels of clusters of undirected, weighted edges, from the finest on; nodes without edges of positive weight have no row.

    At each level the nodes move until no round raises the modularity by LEAST_RISE; then clusters become nodes, with the weight inside as a loop. The last level
    is the one from which no further level rises. A level of more than ``most`` rounds is an error. A cluster is named by one of its nodes.
    """
    first = pairs = cut(_undirected(edges))
    if pairs.isEmpty():
        return []
    names, levels = None, []
    while True:
        label, value, rounds = _settled(pairs, resolution, most)
        if levels and value - levels[-1].modularity < LEAST_RISE:
            return levels
        names = label.select("id", F.col("c").alias("cluster")) if names is None else names.join(label.select(F.col("id").alias("cluster"), "c"), "cluster").select("id", F.col("c").alias("cluster"))
        names = cut(names)
        levels.append(Level(names, quality(first, names.select("id", F.col("cluster").alias("c")), resolution), rounds))
        inside = pairs.join(label.select(F.col("id").alias("a"), F.col("c").alias("src")), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("dst")), "b")
        smaller = cut(_undirected(inside.select("src", "dst", "w")))
        forget(label, *([pairs] if pairs is not first else []))
        pairs = smaller


def as_table(levels: list[Level]) -> DataFrame:
    """(level, id, cluster) of all levels."""
    tables = [level.clusters.select(F.lit(i).alias("level"), "id", "cluster") for i, level in enumerate(levels)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def louvain(edges: DataFrame, resolution: float = 1.0, most: int = 1000) -> DataFrame:
    """(id, cluster) of the last level: labels 0..C-1 by falling size, equal sizes by falling name."""
    levels = hierarchy(edges, resolution, most)
    if not levels:
        return edges.select(F.col("src").alias("id"), F.lit(0).alias("cluster")).limit(0)
    return by_cluster_size(levels[-1].clusters).select("id", F.col("rank").alias("cluster"))
