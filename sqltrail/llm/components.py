"""Connected components by alternating star contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    tied = down.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.unionByName(least.select(F.col("m").alias("a"), "b")).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for the nodes of `edges` (`a, b`: long); the root is the smallest node reachable.

    Rounds of large and small stars until the edges no longer change; the number of rounds grows with the
    logarithm of the size. Each round is written, and a round's edges never outnumber the first's.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges).distinct()).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now
