"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b: neighbours are tied to the smallest one. Large: each node's larger neighbours;
    small: its smaller ones and itself. Minima are summed up before the shuffle; the join's large keys can be split."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = both.join(least, "a")
    if large:
        new = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, label`` for each node with an edge; label: the smallest node it can reach. ``edges``: (a, b), long.

    Each round is written to the shared folder; rounds end when the stars no longer change (about the
    logarithm of the longest path)."""
    at = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    mark = None
    for _ in range(rounds):
        new = write_table(_star(_star(at, True), False), "star")
        drop_table(at)
        at = new
        seen = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
