"""Connected components of a graph that is only ever held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import written


def _largest(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _smallest(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are all tied to the least of them. Edges run from the larger node to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ties = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ties.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _strays(edges: DataFrame) -> DataFrame:
    """Nodes that keep ``edges`` from being stars: larger ends with two neighbours, or whose neighbour is no least one."""
    end = lambda c, up: edges.select(F.col(c).alias("node"), F.lit(up).alias("up"))
    ends = end("a", 1).unionByName(end("b", 0)).groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return ends.where("ups > 1 or (ups = 1 and least = 0)")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of ``edges`` (``a``, ``b``: longs).

    Large-star and small-star steps alternate until all edges form stars, which no
    further step changes; their number grows with the logarithm of the size of a
    component. Minima are pre-aggregated, and every step's edges are written to the
    shared folder.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        edges = written(_smallest(_largest(edges)), "components")
        if not _strays(edges).count():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
