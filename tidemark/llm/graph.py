"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` for the nodes of ``edges (a, b)``; the label is the smallest node reachable.

    Alternating large-star and small-star steps: every node points its larger
    neighbours, then its smaller ones, to its smallest one.  The number of edges
    never grows, the rounds are logarithmic in practice, and each round is a
    minimum (combined on the map side) and a join.  The edges of each round are a
    table in the shared folder, so lineage does not grow and a lost executor
    costs one round.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        now = stored(small.distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
