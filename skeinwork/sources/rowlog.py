"""Log files of rows (``.table``) as a data source, a writer and a check.

A record is the key, then for each column its name, the number of bytes and the bytes, each followed by a blank, and a line
feed. The last record of a key holds.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, cols map<string,binary>, file string, position bigint"


class BadRecord(ValueError):
    """A record that can't be read, with the position at which it begins."""


def encode_row(key: str, cols: dict[str, bytes]) -> bytes:
    """A record with its line feed. Keys and names must not hold blanks or line feeds."""
    out = [key.encode(), b" "]
    for name, value in cols.items():
        if " " in name or "\n" in name:
            raise ValueError(f"a column name can't hold blanks: {name!r}")
        out += [name.encode(), b" ", str(len(value)).encode(), b" ", value, b" "]
    if " " in key or "\n" in key:
        raise ValueError(f"a key can't hold blanks: {key!r}")
    return b"".join(out) + b"\n"


def decode_rows(data: bytes) -> Iterator[tuple[int, str, dict[str, bytes]]]:
    """Position, key and columns of each record; BadRecord at the first that is cut off or malformed."""
    at, size = 0, len(data)
    while at < size:
        begin = at
        try:
            blank = data.index(b" ", at)
            key, at, cols = data[at:blank].decode(), blank + 1, {}
            while data[at : at + 1] != b"\n":
                blank = data.index(b" ", at)
                name = data[at:blank].decode()
                mark = data.index(b" ", blank + 1)
                n = int(data[blank + 1 : mark])
                at = mark + 1 + n
                if n < 0 or data[at : at + 1] != b" ":
                    raise ValueError("no blank behind a value")
                cols[name] = data[mark + 1 : at]
                at += 1
            at += 1
        except ValueError as e:
            raise BadRecord(f"record at {begin}: {e}") from e
        yield begin, key, cols


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, mode: str) -> None:
        self.path, self.mode = path, mode

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.table"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(p) for p in found] or [_File("")]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if not part.path:
            return
        with open(part.path, "rb") as f:
            data = f.read()
        try:
            for at, key, cols in decode_rows(data):
                yield key, cols, part.path, at
        except BadRecord:
            if self.mode == "failfast":
                raise


class RowLogSource(DataSource):
    """``spark.read.format("rowlog").load(path)``: a file, a pattern or a folder of ``.table`` files, one task each.

    Option ``mode``: ``failfast`` (default) raises at a bad record; ``permissive`` keeps what stands before it.
    """

    @classmethod
    def name(cls) -> str:
        return "rowlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options.get("path", ""), self.options.get("mode", "failfast").lower())


def read_log(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """All records of log files."""
    spark.dataSource.register(RowLogSource)
    return spark.read.format("rowlog").option("mode", mode).load(path)


def read_table(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """``key`` and ``cols`` of the last record of each key."""
    log = read_log(spark, path, mode)
    return log.groupBy("key").agg(F.max_by("cols", F.struct("file", "position")).alias("cols"))


def write_log(df: DataFrame, path: str) -> int:
    """Writes ``key``, ``cols`` to one log file, streaming from the executors; the number of records."""
    n = 0
    with open(path, "wb") as f:
        for r in df.select("key", "cols").toLocalIterator(prefetchPartitions=True):
            f.write(encode_row(r.key, {k: bytes(v) for k, v in (r.cols or {}).items()}))
            n += 1
    return n


def check_file(path: str) -> tuple[int, str | None, str | None]:
    """Records of a file, the key of the last good one and the problem behind it, if any."""
    n, last = 0, None
    try:
        with open(path, "rb") as f:
            for _, key, _ in decode_rows(f.read()):
                n, last = n + 1, key
    except BadRecord as e:
        return n, last, str(e)
    return n, last, None
