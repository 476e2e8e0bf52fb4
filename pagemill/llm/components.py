"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import brief_shuffles, cut


def _toward_least(links: DataFrame) -> DataFrame:
    """Every link (src, dst) with the least node among src and all that src links to."""
    least = links.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("_s"), F.least("src", "least").alias("least"))
    return links.join(least, F.col("src") == F.col("_s")).drop("_s")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """One row per node of the edges (src, dst): node and component, the least node that it reaches.

    Loops and repeated edges change nothing; no edges give no rows. Each round writes its links to a checkpoint; a graph
    needs about as many rounds as the logarithm of its longest path. Raises if the given number doesn't do.
    """
    links = cut(edges.filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _toward_least(both).filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
        stars = _toward_least(large)
        small = stars.filter("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(stars.select("src", F.col("least").alias("dst"))).distinct()
        changed = cut(small)
        # A star forest has every node under one least node only, and no least node under another.
        with brief_shuffles(links.sparkSession):
            done = changed.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty() and changed.join(changed.select(F.col("src").alias("dst")), "dst", "left_semi").isEmpty()
        links = changed
        if done:
            roots = links.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            return cut(links.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
