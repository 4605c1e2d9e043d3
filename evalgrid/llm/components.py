"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): each v with the least of u and all of u's partners. The minimum is combined before the shuffle, so a
    vertex with very many partners costs one row a task; the join back is one that Spark can split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of long ids -> (id, component) for every id in an edge; component is the smallest id it reaches.

    Null ends are ignored, repeated edges and loops are harmless, no edges give no rows. Each round is written to the
    shared folder; rounds needed grow with the logarithm of the longest chain. Raises if `rounds` were not enough.
    """
    current = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = _star(large)
        before = current
        current = stored(small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v"))).where("u <> v").distinct(), "stars")
        discard(before)
        now = current.agg(F.count("*"), F.sum(F.col("u").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(20,0)")), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return members.unionByName(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds, {current.count()} edges being left")
