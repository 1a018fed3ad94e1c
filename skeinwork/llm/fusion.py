"""One ranking from several scores of different scales: median rank aggregation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.joins import join_key_stats
from skeinwork.operators.ranking import add_rank, running_sum
from skeinwork.session import extent, stage


def rank_items(df: DataFrame, group: str, item: str, weights: Mapping[str, float]) -> DataFrame:
    """The items of each group with their ranks: one row per group and item.

    For every score column of ``weights``, ``rank_<score>`` is 1 + the number of items of the group with a strictly higher
    score. ``median_rank`` is the weighted median of an item's ranks (the smallest rank at which the ranks up to it have
    half of the weight), ``mean_rank`` their weighted mean, ``n_items`` the size of the group. Scores only ever meet
    through their ranks, so their ranges and distributions do not matter.

    Defined results: an item without a group, an item or one of the scores (null or NaN) takes no part; repeated rows of an
    item count once, with the highest of each score; ties share a rank; an empty table gives no rows; other columns are
    ignored.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("each score needs a positive weight")
    scores = list(weights)
    usable = F.col(group).isNotNull() & F.col(item).isNotNull()
    for s in scores:
        usable &= F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    rows = df.where(usable).groupBy(group, item).agg(*[F.max(s).alias(s) for s in scores])
    rows = stage(rows, "items")
    total = extent(rows)[0]
    for s in scores:
        rows = add_rank(rows, group, s, f"rank_{s}", total)
    pairs = F.array_sort(F.array(*[F.struct(F.col(f"rank_{s}").alias("r"), F.lit(float(weights[s])).alias("w")) for s in scores]))
    weight = sum(weights.values())
    begin = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("bigint").alias("r"))
    step = lambda a, x: F.struct((a.w + x.w).alias("w"), F.when(a.r.isNull() & (a.w + x.w >= weight / 2), x.r).otherwise(a.r).alias("r"))
    mean = sum((F.col(f"rank_{s}") * F.lit(weights[s] / weight) for s in scores), F.lit(0.0))
    rows = rows.withColumn("median_rank", F.aggregate(pairs, begin, step).r).withColumn("mean_rank", mean)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_items"))
    return join_key_stats(stage(rows, "ranked"), stage(sizes, "sizes"), [group], "n_items", total)


def aggregate_ranks(df: DataFrame, group: str, item: str, weights: Mapping[str, float]) -> DataFrame:
    """``rank_items`` with ``position``: 1 for the first item of each group by median rank, then mean rank, then item."""
    rows = rank_items(df, group, item, weights)
    ordered = running_sum(rows, [group], [F.col("median_rank"), F.col("mean_rank"), F.col(item)], F.lit(1), "position")
    return ordered.withColumn("position", F.col("position") + 1)
