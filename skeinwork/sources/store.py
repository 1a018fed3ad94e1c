"""Key/value table semantics over DataFrames, and a catalog of durable tables.

A store table is a DataFrame with a ``key`` column; in its generic form also ``cols``, a map of column names to values. Reads
are lazy plans that prune files by key; writes are whole new versions, as suits immutable files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.joins import small

DELIMITER = "@@!!##"
PAGE_ROWS, CELL_CHARS = 10, 500


def scan(df: DataFrame, start: str | None = None, end: str | None = None, key: str = "key") -> DataFrame:
    """Rows with ``start`` <= key < ``end``; an absent bound is open. With start >= end the range wraps around: keys from
    ``start`` on and keys before ``end``."""
    low = F.col(key) >= start if start is not None else None
    high = F.col(key) < end if end is not None else None
    if low is None or high is None:
        return df if low is None and high is None else df.where(high if low is None else low)
    return df.where((low | high) if start >= end else (low & high))


def get_row(df: DataFrame, value: object, key: str = "key") -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def get_cell(df: DataFrame, value: object, column: str, key: str = "key") -> DataFrame:
    return get_row(df, value, key).select(column)


def get_rows(df: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """The rows of the wanted keys; a key that is asked for twice comes twice, an unknown one not at all."""
    return df.join(small(wanted.select(key)), key)


def exists(df: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """The distinct wanted keys with ``found``."""
    return wanted.select(key).distinct().join(df.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last record of each key: a log of puts as a table. Combined on the map side, so hot keys don't gather."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), order)
    return df.groupBy(*keys).agg(newest.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def put_cells(df: DataFrame, puts: DataFrame) -> DataFrame:
    """A generic table after upserts of single cells: ``puts`` has key, column, value and ``seq``, whose last one wins; other
    cells stay."""
    news = puts.groupBy("key", "column").agg(F.max_by("value", "seq").alias("value"))
    news = news.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__new"))
    both = df.join(news, "key", "full_outer")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce("cols", empty), F.coalesce("__new", empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return both.select("key", F.map_concat(kept, new).alias("cols"))


def put_rows(df: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """A table after upserts of whole rows, which replace all columns."""
    return df.join(rows.select(key), key, "left_anti").unionByName(rows)


def append_rows(df: DataFrame, rows: DataFrame, columns: Iterable[str], key: str = "key") -> DataFrame:
    """A table after a merge by column: the old value, the delimiter and the new value where both exist."""
    columns = list(columns)
    both = df.alias("o").join(rows.alias("n"), F.col("o." + key) == F.col("n." + key), "full_outer")
    merged = [F.when(F.coalesce(f"o.{c}", f"n.{c}").isNotNull(), F.concat_ws(DELIMITER, f"o.{c}", f"n.{c}")).alias(c) for c in columns]
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *merged)


def page_view(df: DataFrame, start: str | None = None, key: str = "key", rows: int = PAGE_ROWS) -> DataFrame:
    """One page of a table in the order of its keys, from ``start`` on, and the first row of the next page; long cells are cut
    and marked."""
    cut = [F.when(F.length(F.col(c).cast("string")) > CELL_CHARS, F.concat(F.substring(F.col(c).cast("string"), 1, CELL_CHARS), F.lit("..."))).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns if c != key]
    return scan(df, start, None, key).orderBy(key).limit(rows + 1).select(key, *cut)


def columns_of(df: DataFrame) -> DataFrame:
    """The distinct column names of a generic table."""
    return df.select(F.explode(F.map_keys("cols")).alias("column")).distinct()


class Catalog:
    """Durable tables by name. Conflicts and unknown tables raise."""

    def __init__(self, spark: SparkSession, database: str = "default") -> None:
        self.spark, self.database = spark, database

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def persist(self, table: str, schema: str) -> DataFrame:
        """Creates an empty table unless it exists."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({schema}) USING parquet")
        return self.table(table)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def write(self, table: str, df: DataFrame, mode: str = "append") -> None:
        df.write.mode(mode).format("parquet").saveAsTable(self._name(table))

    def rename(self, old: str, new: str) -> None:
        if self.spark.catalog.tableExists(self._name(new)):
            raise ValueError(f"table {new} exists")
        self.spark.sql(f"ALTER TABLE {self._name(old)} RENAME TO {self._name(new)}")

    def delete(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")

    def count(self, table: str) -> int:
        return self.table(table).count() if self.spark.catalog.tableExists(self._name(table)) else 0

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def sizes(self) -> DataFrame:
        """``name``, ``n_rows``, ``n_bytes``, ``persistent`` of every table; sizes come from file statistics, not from the rows, where there are any."""
        rows = []
        for t in self.tables():
            self.spark.sql(f"ANALYZE TABLE {self._name(t)} COMPUTE STATISTICS")
            said = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {self._name(t)}").collect()}
            found = re.findall(r"\d+", said.get("Statistics") or "")
            size, n = (int(found[0]), int(found[1])) if len(found) > 1 else (0, 0)
            rows.append((t, n, size, said.get("Type") in ("MANAGED", "EXTERNAL")))
        return self.spark.createDataFrame(rows, "name string, n_rows bigint, n_bytes bigint, persistent boolean")

    def compact(self, table: str, keys: list[str], order: Column, temporary: str | None = None) -> None:
        """Rewrites a log table with only the last record of each key."""
        new = temporary or f"{table}__compacted"
        self.write(new, latest(self.table(table), keys, order), "overwrite")
        self.delete(table)
        self.rename(new, table)
