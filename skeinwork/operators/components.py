"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.joins import join_key_stats
from skeinwork.session import stage


def _star(edges: DataFrame, large: bool, label: str) -> DataFrame:
    """One large-star or small-star step: links go to the least node in reach."""
    sides = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    if not large:
        sides = sides.where("o < n")
    stats = stage(sides.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"), F.count(F.lit(1)).alias("c")), label)
    total = stats.agg(F.sum("c")).first()[0] or 0
    near = join_key_stats(sides, stats, ["n"], "c", total)
    if large:
        out = near.where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("o").alias("u"), F.col("m").alias("v")).unionByName(stats.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """``node``, ``component`` (the least node of its component) of every node that has a link.

    Large-star and small-star steps by turns (a logarithmic number of rounds); each round is written to the shared folder,
    minima are combined on the map side, and joins are balanced for nodes with many links. Links with a null end and
    links of a node to itself are ignored; repeated links count once.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    links, before = stage(links, "links"), None
    for _ in range(rounds):
        links = stage(_star(_star(links, True, "large"), False, "small"), "stars")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
