"""Connected components of an edge table, and joins against sides of a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitbars.session import staged

#: A side is broadcast only when a count has shown at most so many rows of a few numbers.
BROADCAST_ROWS = 1_000_000


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join; ``right`` (narrow, already stored) is broadcast if its count allows, else shuffled."""
    if right.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return left.join(right, list(on), how)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that an edge ``a, b`` (bigint) touches.

    ``root`` is the smallest node that can be reached. Each round points the larger neighbours
    of a node at its smallest one, then the smaller ones likewise, as an aggregate and a join;
    no task holds a node's neighbours. Rounds are stored, so a lost executor costs one re-read.
    They end when the edge set no longer changes.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = staged(pairs.where("a <> b").distinct(), "edges")
    mark = _mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        high = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        root = high.groupBy("a").agg(F.min("b").alias("m"))
        low = high.join(root, "a")
        low = low.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            root.select("a", F.col("m").alias("b"))
        )
        pairs = staged(low.distinct(), "edges")
        new = _mark(pairs)
        if new == mark:
            break
        mark = new
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return tuple(row)
