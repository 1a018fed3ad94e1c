"""Joins that stay balanced when a key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.session import extent, width

#: A key is hot from one HOT_PARTS-th of all rows on, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1024
#: Rows and bytes up to which a side that was counted may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def small(df: DataFrame, of: DataFrame | None = None, most: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows and ``size`` bytes, else as it is (a shuffle join).

    The extent of a staged table is known; ``of`` names a staged table that ``df`` is a part of, if there is one. Otherwise, or if that
    table is too large, rows are counted, ``most`` + 1 at the most; that runs what ``df`` does, so what is dear should be staged.
    """
    known = extent(df) or (extent(of) if of is not None else None)
    if known is None or (of is not None and (known[0] > most or known[1] > size)):
        rows, held = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(width(df.schema))).first()
        known = rows, held or 0
    return F.broadcast(df) if known[0] <= most and known[1] <= size else df


def join_key_stats(facts: DataFrame, stats: DataFrame, keys: Sequence[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """``facts`` with the columns of ``stats``, which has one row per key and in ``rows`` the number of facts of that key.

    Facts of hot keys meet their statistics by broadcast: at most ``HOT_PARTS`` rows of ``stats`` qualify, by definition, so
    the size of what is sent is bounded. All other facts are shuffled, and no key among them has more than one
    HOT_PARTS-th of the rows. ``total`` is the number of facts. Keys that are null match nothing.
    """
    keys = list(keys)
    hot = stats.where(F.col(rows) * HOT_PARTS >= F.lit(total))
    warm = facts.join(F.broadcast(hot), keys)
    rest = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(stats, keys, how)
    return warm.unionByName(rest)
