"""Values of each group as ordered lists, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.joins import small
from skeinwork.operators.ranking import running_sum
from skeinwork.session import extent, stage

#: Elements of one list, at most.
PART = 10_000


def listed(rows: DataFrame, group: Sequence[str], order: Sequence[str], element: str, size: int = PART) -> DataFrame:
    """``group``, ``part`` (from 0), ``n``, ``list``: the elements of each group in ``order``, ``size`` of them a part.

    Groups of up to ``size`` rows meet in one task, by a single shuffle. Only the rows of larger ones are numbered first, over as
    many tasks as they need, so that no list, and no task, grows with a hot group. ``rows`` is read several times: stage it where
    that is dear. ``order`` must be total within a group, its columns of types that sort; a null in ``group`` is a value like any other.
    """
    group, order = list(group), list(order)
    rows = rows.select(*group, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.col(element).alias("__e"))
    keys = [f"__o{i}" for i in range(len(order))]
    hot = stage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select(*[F.col(g).alias(f"__g_{g}") for g in group]), "hot-groups")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*keys, "__e"))), lambda x: x["__e"])
    made = [F.count(F.lit(1)).alias("n"), ordered.alias("list")]
    if not extent(hot)[0]:
        return rows.groupBy(*group).agg(*made).select(*group, F.lit(0).alias("part"), "n", "list")
    hot, same = small(hot), F.lit(True)
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    cold = rows.join(hot, same, "left_anti").groupBy(*group).agg(*made).select(*group, F.lit(0).alias("part"), "n", "list")
    numbered = running_sum(rows.join(hot, same, "left_semi"), group, [F.col(k) for k in keys], F.lit(1), "__place")
    parts = numbered.groupBy(*group, F.floor(F.col("__place") / size).cast("int").alias("part")).agg(*made)
    return cold.unionByName(parts.select(*group, "part", "n", "list"))
