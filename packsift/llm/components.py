"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.llm.tables import settle


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` ``(a, b)``; the root is the smallest
    node that links reach.

    Rounds of large-star and small-star: every node hands its neighbours to its
    smallest neighbour, first the larger ones, then the others, until nothing changes.
    Each round is written, so lost executors cost one round at most; neighbours of one node are
    never gathered, only their minimum is.
    """
    def fingerprint(df: DataFrame):
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        return row["n"], row["h"]

    edges = settle(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # At most a row for each edge, so it need not be made distinct on the way.
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where(F.col("a") != F.col("b"))
        # b > a throughout: hand the smaller neighbours of b to the smallest
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b")
        edges = settle(
            small.select(F.col("m").alias("a"), "b")
            .unionByName(small.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b")))
            .distinct(),
            "edges",
        )
        after = fingerprint(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
