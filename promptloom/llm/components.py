"""Connected components of a graph given by its links, over any number of tasks.

Alternating large-star and small-star steps: each node links its larger neighbours to the
smallest node it knows, then its smaller neighbours. The number of links never grows, and a
round is two aggregations and two joins. Each round is written to the shared folder. It is
the last one if its links are stars already, which one aggregation shows: no node has two
smaller ones, or is linked from both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` go from larger nodes ``a`` to smaller ones ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each distinct link goes from a node without others to a root."""
    ends = links.selectExpr("stack(2, a, 1, b, 0) AS (node, up)").groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return ends.where("up > 1 OR up = 1 AND n > 1").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)`` but the roots themselves.

    The root is the smallest node of a component. Links in either direction, repeated links
    and links of a node to itself are allowed; without links the result is empty.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        pairs = materialise(pairs, "stars")
        if _are_stars(pairs):
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        pairs = _small_star(_large_star(pairs))
