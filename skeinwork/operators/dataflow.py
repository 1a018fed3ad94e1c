"""The key/value dataflow algebra as lazy DataFrame plans.

Two shapes: ``Values`` has one column ``value`` (a multiset of strings), ``Pairs`` has ``key`` and ``value`` (a multimap, one row per
pair). Every step takes either a column expression, planned and compiled by the engine, or a Python function, run over
Arrow batches. Nothing is materialised between steps.

In all steps, null elements and null results are dropped; keys may hold any characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.operators.lists import PART, listed
from skeinwork.sources.store import Catalog

VALUE = T.StructType([T.StructField("value", T.StringType())])
PAIR = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
Step = Column | Callable[..., Any]
#: Keys whose totals a task keeps at a time while it folds.
HELD_KEYS = 200_000


def _text(x: Any) -> str | None:
    return None if x is None else x if isinstance(x, str) else str(x)


def _value_batches(make: Callable[..., Iterable[Any] | None], skip_errors: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    out += [_text(x) for x in (make(*row) or ()) if x is not None]
                except Exception:
                    if not skip_errors:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def _pair_batches(make: Callable[..., Iterable[tuple[Any, Any]] | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [p for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for p in (make(*row) or ()) if p is not None and p[0] is not None and p[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([_text(k) for k, _ in got], pa.string()), pa.array([_text(v) for _, v in got], pa.string())], names=["key", "value"])

    return run


class Values:
    """A multiset of strings."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    # -- projections

    def flat_map(self, step: Step, skip_errors: bool = False) -> Values:
        """0..n elements for each; a column step is an array, a Python step returns an iterable or None. ``skip_errors``: elements
        for which a Python step raises give nothing."""
        if isinstance(step, Column):
            return Values(self.df.select(F.explode(step).alias("value")).select(F.col("value").cast("string").alias("value")).where("value IS NOT NULL"))
        return Values(self.df.select("value").mapInArrow(_value_batches(step, skip_errors), VALUE))

    def flat_map_shuffled(self, step: Step, seed: int = 0) -> Values:
        """``flat_map`` over the elements spread at random (by a seeded hash, so that a retried task sees the same ones);
        elements with errors are skipped."""
        spread = self.df.repartition(F.xxhash64("value", F.lit(seed)))
        return Values(spread).flat_map(step, skip_errors=not isinstance(step, Column))

    def flat_map_to_pair(self, step: Step) -> Pairs:
        """A column step is an array of structs (key, value); a Python step returns an iterable of tuples or None."""
        if isinstance(step, Column):
            s = self.df.select(F.explode(step).alias("p"))
            a, b = s.schema["p"].dataType.names
            return Pairs(s.select(F.col(f"p.{a}").cast("string").alias("key"), F.col(f"p.{b}").cast("string").alias("value")).where("key IS NOT NULL AND value IS NOT NULL"))
        return Pairs(self.df.select("value").mapInArrow(_pair_batches(step), PAIR))

    def map_to_pair(self, key: Step, value: Column | None = None) -> Pairs:
        """One pair for each element: two column expressions, or a Python function that returns a tuple or None."""
        if isinstance(key, Column):
            v = F.col("value") if value is None else value
            return Pairs(self.df.select(key.cast("string").alias("key"), v.cast("string").alias("value")).where("key IS NOT NULL AND value IS NOT NULL"))
        return Pairs(self.df.select("value").mapInArrow(_pair_batches(lambda v, f=key: [f(v)]), PAIR))

    def key_by(self, key: Step) -> Pairs:
        """(key, element) for each element."""
        if isinstance(key, Column):
            return self.map_to_pair(key)
        return self.map_to_pair(lambda v: (key(v), v))

    def filter(self, step: Step) -> Values:
        if isinstance(step, Column):
            return Values(self.df.where(step))
        return Values(self.df.select("value").mapInArrow(_value_batches(lambda v: [v] if step(v) else None), VALUE))

    def map_partitions(self, step: Callable[[Iterator[str]], Iterable[str]]) -> Values:
        """A function of an iterator over a partition's elements, called once for each partition."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            elements = (v for b in batches for v in b.column(0).to_pylist() if v is not None)
            held: list[str] = []
            for x in step(elements) or ():
                if x is not None:
                    held.append(_text(x))
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

        return Values(self.df.select("value").mapInArrow(run, VALUE))

    def sample(self, p: float, seed: int | None = None) -> Values:
        """Each element with probability ``p``."""
        return Values(self.df.sample(withReplacement=False, fraction=float(p), seed=seed))

    # -- groups

    def group_concat(self, key: Step) -> Pairs:
        """(key, its elements joined by commas, in order): one string a key, so for keys whose elements fit in a task; else
        ``group_parts``."""
        return self.key_by(key).fold_by_key_with(F.array_join(F.array_sort(F.collect_list("value")), ","))

    def group_parts(self, key: Step, size: int = PART) -> DataFrame:
        """``group_concat`` for keys of any size: ``key``, ``part``, ``n``, ``value`` with at most ``size`` elements in each part; no task
        gets more than that of a hot key."""
        return self.key_by(key).wide_parts(size).withColumn("value", F.array_join("values", ",")).drop("values")

    def distinct(self) -> Values:
        return Values(self.df.distinct())

    def intersection(self, other: Values) -> Values:
        """Distinct elements of both."""
        return Values(self.df.select("value").intersect(other.df.select("value")))

    def union(self, other: Values) -> Values:
        return Values(self.df.select("value").unionByName(other.df.select("value")))

    def subtract(self, other: Values) -> Values:
        """Elements less one for each equal element of ``other``."""
        return Values(self.df.select("value").exceptAll(other.df.select("value")))

    def first_by(self, prefix: str) -> Values:
        """Of the elements that are alike before the delimiter ``prefix`` only the least one: elements keyed by what they begin with."""
        head = F.substring_index("value", prefix, 1)
        return Values(self.df.groupBy(head.alias("k")).agg(F.min("value").alias("value")).select("value"))

    # -- results

    def fold(self, zero: str, step: Callable[[str, str], str]) -> str:
        """The elements combined by an associative function with the neutral element ``zero``.

        Partitions are folded where they are; their results, one for each partition, are folded in a tree, so none but the
        last few reach one place.
        """

        def part(elements: Iterator[str]) -> Iterable[str]:
            total = zero
            for v in elements:
                total = step(total, v)
            yield total

        parts = self.map_partitions(part)
        while (width := parts.df.rdd.getNumPartitions()) > 64:
            parts = Values(parts.df.repartition(width // 32)).map_partitions(part)
        total = zero
        for row in parts.df.toLocalIterator():
            total = step(total, row.value)
        return total

    def aggregate(self, how: Column) -> DataFrame:
        """A fold in its column form: one row with an aggregate of ``value``."""
        return self.df.agg(how.alias("value"))

    def count(self) -> int:
        return self.df.count()

    def take(self, n: int) -> list[str]:
        return [r.value for r in self.df.limit(n).collect()]

    def collect(self) -> list[str]:
        return [r.value for r in self.df.select("value").collect()]

    def save_as_table(self, name: str, mode: str = "errorifexists") -> Values:
        self.df.write.mode(mode).saveAsTable(name)
        return Values(self.df.sparkSession.table(name))


class Pairs:
    """A multimap of strings."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def flat_map(self, step: Step) -> Values:
        if isinstance(step, Column):
            return Values(self.df.select(F.explode(step).alias("value")).select(F.col("value").cast("string").alias("value")).where("value IS NOT NULL"))
        return Values(self.df.select("key", "value").mapInArrow(_value_batches(step), VALUE))

    def flat_map_to_pair(self, step: Step) -> Pairs:
        if isinstance(step, Column):
            s = self.df.select(F.explode(step).alias("p"))
            a, b = s.schema["p"].dataType.names
            return Pairs(s.select(F.col(f"p.{a}").cast("string").alias("key"), F.col(f"p.{b}").cast("string").alias("value")).where("key IS NOT NULL AND value IS NOT NULL"))
        return Pairs(self.df.select("key", "value").mapInArrow(_pair_batches(step), PAIR))

    def map_values(self, value: Column) -> Pairs:
        return Pairs(self.df.select("key", value.cast("string").alias("value")).where("value IS NOT NULL"))

    def fold_by_key_with(self, how: Column) -> Pairs:
        """One pair for each key with an aggregate of its values; combined on the map side where the aggregate allows it."""
        return Pairs(self.df.groupBy("key").agg(how.cast("string").alias("value")).where("value IS NOT NULL"))

    def fold_by_key(self, zero: str, step: Callable[[str, str], str], commutative: bool = False) -> Pairs:
        """One pair for each key: its values, in ascending order, combined by a Python function from ``zero`` on.

        With ``commutative`` the function must be associative and commutative, with the neutral element ``zero``: values are then
        folded where they are, and only one result for each key and task is shuffled, so that no task holds all values of a hot
        key, equal ones or not. Otherwise a key's values meet in one task, in order. A None as the result drops the key. A column
        aggregate (``fold_by_key_with``) is the faster way wherever one exists.
        """
        import pandas as pd

        def fold(frame: pd.DataFrame) -> pd.DataFrame:
            total: str | None = zero
            for v in frame["value"].sort_values():
                total = step(total, v)
            return pd.DataFrame({"key": [frame["key"].iloc[0]], "value": [_text(total)]})

        def flushed(totals: dict[str, str | None]) -> pa.RecordBatch:
            got = [(k, v) for k, v in totals.items() if v is not None]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([_text(v) for _, v in got], pa.string())], names=["key", "value"])

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[str, str | None] = {}
            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    totals[k] = step(totals.get(k, zero), v)
                if len(totals) > HELD_KEYS:
                    yield flushed(totals)
                    totals = {}
            yield flushed(totals)

        df = self.df.select("key", "value").where("key IS NOT NULL AND value IS NOT NULL")
        if commutative:
            df = df.mapInArrow(here, PAIR)
        return Pairs(df.groupBy("key").applyInPandas(fold, PAIR).where("value IS NOT NULL"))

    def join(self, other: Pairs) -> Pairs:
        """Inner join by key with full multiplicity: (key, "left,right")."""
        joined = self.df.alias("l").join(other.df.alias("r"), F.col("l.key") == F.col("r.key"))
        return Pairs(joined.select(F.col("l.key").alias("key"), F.concat_ws(",", "l.value", "r.value").alias("value")))

    def cogroup(self, other: Pairs) -> Pairs:
        """(key, "[left values],[right values]") of every key of either side; values in ascending order, ``[]`` for none. For keys
        whose values fit in a task; else ``cogroup_parts``."""
        both = self.df.select("key", F.lit(0).alias("side"), "value").unionByName(other.df.select("key", F.lit(1).alias("side"), "value"))
        listed = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("value")))), ",") for s in (0, 1)]
        text = F.concat(F.lit("["), listed[0], F.lit("],["), listed[1], F.lit("]"))
        return Pairs(both.groupBy("key").agg(text.alias("value")))

    def cogroup_parts(self, other: Pairs, size: int = PART) -> DataFrame:
        """``cogroup`` for keys of any size: ``key``, ``side`` (0 or 1), ``part``, ``n``, ``values`` with at most ``size`` values in each part."""
        both = self.df.select("key", F.lit(0).alias("side"), "value").unionByName(other.df.select("key", F.lit(1).alias("side"), "value"))
        return listed(both, ["key", "side"], ["value"], "value", size).withColumnRenamed("list", "values")

    def semi_join(self, other: Pairs | Values) -> Pairs:
        """Pairs whose key the other side has."""
        return Pairs(self.df.join(_keys(other), "key", "left_semi"))

    def anti_join(self, other: Pairs | Values) -> Pairs:
        """Pairs whose key the other side has not."""
        return Pairs(self.df.join(_keys(other), "key", "left_anti"))

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list[tuple[str, str]]:
        return [(r.key, r.value) for r in self.df.select("key", "value").collect()]

    def wide(self) -> DataFrame:
        """One row for each key with its values, in order, as a list."""
        return self.df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("values"))

    def wide_parts(self, size: int = PART) -> DataFrame:
        """``wide`` for keys of any size: ``key``, ``part``, ``n``, ``values`` with at most ``size`` values in each part."""
        return listed(self.df, ["key"], ["value"], "value", size).withColumnRenamed("list", "values")

    def save_as_table(self, name: str, mode: str = "errorifexists") -> Pairs:
        """Saved in long form, one row for each pair, whatever the number of values of a key."""
        self.df.write.mode(mode).saveAsTable(name)
        return Pairs(self.df.sparkSession.table(name))


def _keys(other: Pairs | Values) -> DataFrame:
    column = "key" if isinstance(other, Pairs) else "value"
    return other.df.select(F.col(column).alias("key"))


class Context:
    """Entry points of a job."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._output: list[str] = []
        self._parallelism: int | None = None

    def parallelize(self, values: Iterable[str], table: str | None = None, mode: str = "append") -> Values:
        """The given elements; with ``table`` they are also added to that table."""
        df = self.spark.createDataFrame([(v,) for v in values], VALUE)
        if self._parallelism:
            df = df.repartition(self._parallelism)
        out = Values(df)
        return out.save_as_table(table, mode) if table else out

    def from_table(self, table: DataFrame | str, projection: Step) -> Values:
        """One element for each row, by a column expression or a Python function of the row as a dict; nulls are dropped."""
        df = self.spark.table(table) if isinstance(table, str) else table
        if isinstance(projection, Column):
            return Values(df.select(projection.cast("string").alias("value")).where("value IS NOT NULL"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [x for x in map(projection, b.to_pylist()) if x is not None]
                yield pa.RecordBatch.from_arrays([pa.array([_text(x) for x in got], pa.string())], names=["value"])

        return Values(df.mapInArrow(run, VALUE))

    def output(self, text: str) -> None:
        """Adds to the text that a job returns to whoever submitted it."""
        self._output.append(text)

    def result(self) -> str:
        return "".join(self._output) or "No output available"

    @property
    def catalog(self) -> Catalog:
        """Direct access to the durable tables."""
        return Catalog(self.spark)

    def set_concurrency(self, parts: int) -> None:
        """Partitions of what is parallelized from now on."""
        self._parallelism = parts
