"""Connected components by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, scratch, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v); root is the smallest node of its component, itself left out.

    Large and small stars in turn until nothing changes; every round is a table in the shared folder. A hub's minimum is combined
    before its shuffle, and the join back to its neighbours is one that can be split."""
    spark = edges.sparkSession
    folder = scratch(spark, "stars")
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/0")
    mark, n = None, 0
    while True:
        sums = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == (sums["n"], sums["x"]) or not sums["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, n = (sums["n"], sums["x"]), n + 1
        now = stored(_small_star(_large_star(now)), f"{folder}/{n}")
        if n > 1:
            drop_folder(spark, f"{folder}/{n - 2}")
