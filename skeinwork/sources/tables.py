"""Reading the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``; columns and filters used later are pushed into the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def trimmed(c: Column | str) -> Column:
    """Text without white space of any kind around it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal_word(c: Column | str) -> Column:
    """The normal form of an index word: trimmed, lower case; null and blank words give null."""
    w = F.lower(trimmed(c))
    return F.when(w != "", w)
