"""Connected components of a table of links, by alternating large-star and small-star rounds.

The least neighbours are written before they are joined with the links: both sides of that
join are plain shuffles then, and Spark splits the links of a hub over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of every node to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie every node's smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Node and root (the smallest node of its component) for every node that has a link.

    edges has two columns a and b of one orderable type. Links to oneself, repeated and
    reversed links change nothing; rows with a null end are left out; no links give no rows.
    The rounds grow with the logarithm of the number of nodes; every round is written to
    the shared checkpoint folder, and only a fingerprint of the links returns to the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(edges)
    before = None
    for _ in range(max_rounds):
        edges = stored(_small_star(stored(_large_star(edges))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
