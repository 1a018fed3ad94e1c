"""Exact quantiles of every key at once, with no task that sees a hot key's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.operators.joins import small
from skeinwork.session import stage

BITS = 8
#: Distinct values of a bucket that one task gets at each level, about.
PIECE = 100_000


@F.pandas_udf(T.LongType())
def _ordered_bits(v):
    """Doubles as integers of the same order; -0.0 equals 0.0 and NaN is the largest, as in SQL."""
    import numpy as np
    import pandas as pd

    x = v.to_numpy(np.float64, na_value=np.nan) + 0.0
    b = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b))


@F.pandas_udf(T.DoubleType())
def _from_ordered_bits(v):
    import numpy as np
    import pandas as pd

    b = v.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64))


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """The mergeable histogram at full resolution: ``key``, ``v`` (integer of the value's order), ``c`` rows.

    Counts are combined on the map side; a hot key's rows are spread by their values.
    """
    v = F.col(value)
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        v = F.when(v.isNotNull(), _ordered_bits(F.coalesce(v.cast("double"), F.lit(0.0))))
    return df.select(F.col(key).alias("key"), v.cast("bigint").alias("v")).groupBy("key", "v").agg(F.count(F.lit(1)).alias("c"))


def grouped_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """One row per key: ``key``, ``n_rows``, ``n_values`` and, in the order of ``probs``, ``quantiles``.

    The quantile p of n values is the ceil(p * n)-th smallest one (the smallest for p = 0). Distributed selection: a
    histogram of 2^8 buckets per key, from mergeable counts, tells in which bucket each wanted rank lies; that bucket is
    split again into 2^8, until a bucket is a single value. A pass groups by key *and* bucket after map-side combination. Each level
    reads only what the one before it kept, the values of wanted buckets, and a bucket's values are spread over as many tasks as their
    number asks for, so no task gets the values of one key.

    Defined results: a null key is a key like any other, as in GROUP BY; null values count in ``n_rows`` only, and a key
    without any value has null for each quantile; ties and repeated rows count as often as they occur; an empty table gives
    no rows. Integer types and doubles are exact; columns other than ``key`` and ``value`` play no part.
    """
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must be numbers from 0 to 1")
    real = isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType))
    w = stage(value_counts(df, key, value), "value-counts")
    low, high = w.agg(F.min("v"), F.max("v")).first()
    keys = w.groupBy("key").agg(F.sum("c").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("n_values"))
    if low is None:
        empty = F.array(*[F.lit(None).cast("double" if real else "bigint") for _ in probs])
        return keys.select("key", "n_rows", "n_values", empty.alias("quantiles"))

    # levels are bit positions of the values' own order, so that no per-key bounds have to travel to the data
    base = 0 if high - low >= 2**62 else low
    span = max(high - base, base - low if low < base else 0)
    shifts = list(range(max(span.bit_length() - BITS, 0), 0, -BITS)) + [0]
    w = w.where("v IS NOT NULL").select("key", (F.col("v") - F.lit(base)).alias("v"), "c")

    # a level: (key, bucket) -> rows, and distinct values, which tell how far the bucket has to be spread
    levels = F.sum("c").alias("c"), F.count(F.lit(1)).alias("d")
    hist = w.groupBy("key", F.shiftright("v", shifts[0]).alias("b")).agg(*levels)
    order = Window.partitionBy("key").orderBy("b")
    hist = hist.select("key", "b", "c", "d", F.sum("c").over(order).alias("upto"), F.sum("c").over(Window.partitionBy("key")).alias("n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("q"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(float(p)) * F.col("n") - F.lit(1e-9))).alias("r")) for i, p in enumerate(probs)])
    inside = (F.col("r") > F.col("upto") - F.col("c")) & (F.col("r") <= F.col("upto"))
    state = hist.select("*", F.inline(wanted)).where(inside).select("key", "q", "b", "d", (F.col("r") - F.col("upto") + F.col("c")).alias("r"))
    for before, shift in zip(shifts, shifts[1:], strict=False):
        state = stage(state, "ranks-wanted")
        # values of wanted buckets; a bucket that several ranks lie in is kept once
        buckets = state.groupBy("key", "b").agg(F.max("d").alias("d")).withColumn("pieces", F.ceil(F.col("d") / PIECE).cast("int"))
        most = buckets.agg(F.max("pieces")).first()[0] or 1
        buckets = buckets.select("key", "b", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        rows = w.withColumn("b", F.shiftright("v", before)).withColumn("h", F.pmod(F.xxhash64("v"), F.lit(most)).cast("int"))
        if most > 1:
            # pieces differ from bucket to bucket: a value of a bucket of n pieces lies in piece h mod n, and all its sides are n rows
            sizes = small(state.groupBy("key", "b").agg(F.max("d").alias("d")).where(F.col("d") > PIECE).select(F.col("key").alias("k2"), F.col("b").alias("b2"), F.ceil(F.col("d") / PIECE).cast("int").alias("of")))
            rows = rows.join(sizes, F.col("key").eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2")), "left").withColumn("piece", F.col("h") % F.coalesce("of", F.lit(1))).drop("k2", "b2", "of")
        else:
            rows = rows.withColumn("piece", F.lit(0))
        part = rows.alias("l").join(small(buckets).alias("r"), F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.b") == F.col("r.b")) & (F.col("l.piece") == F.col("r.piece")))
        w = part.select("l.key", "l.v", "l.c")
        if shift:
            w = stage(w, "values-kept")
        fine = w.groupBy("key", F.shiftright("v", before).alias("above"), F.shiftright("v", shift).alias("b")).agg(*levels)
        upto = F.sum("c").over(Window.partitionBy("key", "above").orderBy("b"))
        fine = fine.withColumn("upto", upto).alias("f").join(state.select("key", "q", F.col("b").alias("above"), "r").alias("s"), F.col("f.key").eqNullSafe(F.col("s.key")) & (F.col("f.above") == F.col("s.above")))
        state = fine.select("f.key", "s.q", "f.b", "f.c", "f.d", "f.upto", "s.r").where(inside).select("key", "q", "b", "d", (F.col("r") - F.col("upto") + F.col("c")).alias("r"))
    found = (F.col("b") + F.lit(base)).alias("v")
    found = state.select("key", "q", found)
    if real:
        found = found.withColumn("v", _from_ordered_bits("v"))
    picked = F.array(*[F.max(F.when(F.col("q") == i, F.col("v"))) for i in range(len(probs))])
    found = found.groupBy("key").agg(picked.alias("quantiles"))
    out = keys.alias("k").join(found.alias("f"), F.col("k.key").eqNullSafe(F.col("f.key")), "left")
    none = F.array(*[F.lit(None).cast("double" if real else "bigint") for _ in probs])
    return out.select("k.key", "k.n_rows", "k.n_values", F.coalesce("f.quantiles", none).alias("quantiles"))
