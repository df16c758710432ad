"""Connected components over edges of any number, as alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): each node of edges(a, b), long ids, with the smallest node that it reaches.

    Every round is written to the shared folder, with minima and joins read from tables, so that
    adaptive execution broadcasts what is small and splits the join at hubs. Edges that hold a null
    and loops are no edges. No edges: no rows. Stops when a round changes nothing; the number of
    rounds grows with the logarithm of the longest path.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(now)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        # large star: neighbours above u move to u's smallest neighbour (or u)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.keep(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: u and its smaller neighbours move to the smallest of them
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        then = scratch.keep(small)
        scratch.drop(now, low, large, least)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
