"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import dropped, looked_up, owned, staged


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node and root, the smallest node that links reach, for every node but the roots.

    Each round shuffles the edges by node with pre-aggregated minima and no neighbour lists, and is written to the shared folder.
    The edges of a node with very many neighbours are spread over tasks.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = looked_up(both.where("b > a"), least, ["a"], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = looked_up(large, least, ["a"], F.col("b")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        before, now = now, staged(small.distinct(), "edges")
        dropped(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            return owned(now.select(F.col("a").alias("node"), F.col("b").alias("root")), now)
        seen = mark
