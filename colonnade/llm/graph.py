"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges stay in distributed tables; the driver sees only counts and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = both.filter("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return joined.select(F.explode(pairs).alias("e")).select("e.*").filter("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u long, v long) -> (node, root): the smallest node each can reach; nodes without an edge are absent."""
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now = scratch.write(edges.filter("u != v").select(big.alias("u"), small.alias("v")).distinct(), "star0")
    seen, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, k = mark, k + 1
        now = scratch.write(_small_star(_large_star(now)), f"star{k}")
        scratch.drop(f"star{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
