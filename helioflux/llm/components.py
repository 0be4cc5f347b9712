"""Connected components of an edge table: alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two aggregations by key and two equi-joins, so a node with a huge neighbourhood is combined
before it is shuffled and its join partition can be split. Links and labels stay distributed; the driver sees
only whether the edges are stars yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, discard, spill


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether the edges are stars of their least nodes: no node hangs on two others or on one that hangs itself."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.isEmpty() and edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node reachable.

    No edges: an empty table. Loops, repeated and reversed edges are harmless. ``scratch`` takes the table that
    the result reads.
    """
    now = spill(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        later = spill(_small(_large(now)), "edges")
        discard(now)
        now = later
    if scratch is not None:
        scratch.append(now)
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
