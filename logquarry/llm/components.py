"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fewer


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours; ``edges`` has ``u, v``."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _neighbour_minimum(both)
    joined = fewer(both.join(least, "u").where(F.col("v") > F.col("u")), rows)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _neighbour_minimum(down)
    joined = fewer(down.join(least, "u"), rows)
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = fewer(least.select("u", F.col("m").alias("v")), rows)
    return moved.union(kept).where(F.col("u") != F.col("v")).distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of an edge, the root being the least node of its component.

    ``edges`` has two columns of one ordered type. Each round links all larger neighbours of a node, and
    then the smaller ones, to the least node nearby, until the edges are stars; their number of rounds grows with the
    logarithm of the longest path. Edges never grow in number, minima are combined before the shuffle, and each
    round is cut off by a checkpoint.
    """
    first, second = edges.columns
    edges = edges.select(F.col(first).alias("u"), F.col(second).alias("v")).where(F.col("u") != F.col("v"))
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, rows = state, state[0]
        left = fewer(_large_star(fewer(edges, rows), rows), rows)
        edges = cut(fewer(_small_star(left, rows), rows))
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
