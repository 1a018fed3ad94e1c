"""Ranks and running sums within groups, where a group may be as large as the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.joins import join_key_stats
from skeinwork.session import stage


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over the earlier rows of the same group, in ``order``.

    Rows are range-partitioned by group and order, summed within each partition, and shifted by the sums of the group's
    earlier partitions, so a large group is spread over many tasks. ``order`` must be total within a group.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = list(group)
    df = df.withColumn("__w", weight)
    ranged = stage(df.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*group, "__part").agg(F.sum("__w").alias("__sum"))
    ahead = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # of the groups in a range at most one began in an earlier one, so there are no more of these rows than ranges
    sums = sums.withColumn("__shift", F.sum("__sum").over(ahead)).where("__shift IS NOT NULL").select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__part").alias("__at"), "__shift")
    within = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("__before", F.coalesce(F.sum("__w").over(within), F.lit(0)))
    same = F.col("__part") == F.col("__at")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    out = ranged.join(F.broadcast(sums), same, "left").withColumn(name, F.col("__before") + F.coalesce("__shift", F.lit(0)))
    return out.drop("__w", "__part", "__before", "__shift", "__at", *[f"__g_{g}" for g in group])


def add_rank(df: DataFrame, group: str, score: str, name: str, total: int) -> DataFrame:
    """``df`` with ``name``: 1 + the number of rows of its group whose ``score`` is strictly higher.

    Equal scores are counted first, so that ties cost one row; ranks go back to the rows by a join that is balanced for
    hot groups and hot scores. ``total`` is the number of rows. Rows with a null group or score are left out.
    """
    values = df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).groupBy(group, score).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sum(values, [group], [F.col(score).desc()], F.col("__n"), "__higher")
    ranked = stage(ranked.select(group, score, "__n", (F.col("__higher") + 1).alias(name)), "ranks")
    return join_key_stats(df, ranked, [group, score], "__n", total).drop("__n")
