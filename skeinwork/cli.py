"""Commands over durable tables and stored pages: get, put, scan, rename, persist, delete, count, tables, search."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skeinwork.plans import corpus, index, search
from skeinwork.sources import store

SCHEMA = "key string, cols map<string,string>"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skeinwork", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
        return c

    command("get", "table", "key", "column?")
    command("put", "table", "key", "column", "value")
    command("scan", "table", "start?", "end?")
    command("rename", "old", "new")
    command("persist", "table")
    command("delete", "table")
    command("count", "table")
    command("tables")
    s = command("search", "pages", "query")
    s.add_argument("--max", type=float)
    s.add_argument("--limit", type=int, default=search.LIMIT)
    return p


def run(spark: SparkSession, argv: Sequence[str]) -> str:
    """The output of a command."""
    a = parser().parse_args(argv)
    c = store.Catalog(spark)
    if a.command == "persist":
        c.persist(a.table, SCHEMA)
    elif a.command == "put":
        puts = spark.createDataFrame([(a.key, a.column, a.value, 0)], "key string, column string, value string, seq int")
        old = store.get_row(c.table(a.table), a.key)
        row = store.put_cells(old, puts)
        new = f"{a.table}__new"
        c.write(new, store.put_rows(c.table(a.table), row), "overwrite")
        c.delete(a.table)
        c.rename(new, a.table)
    elif a.command == "get":
        rows = store.get_row(c.table(a.table), a.key).collect()
        return "\n".join(str(r.cols.get(a.column)) if a.column else _line(r) for r in rows)
    elif a.command == "scan":
        return "\n".join(map(_line, store.scan(c.table(a.table), a.start, a.end).orderBy("key").toLocalIterator()))
    elif a.command == "rename":
        c.rename(a.old, a.new)
    elif a.command == "delete":
        c.delete(a.table)
    elif a.command == "count":
        return str(c.count(a.table))
    elif a.command == "tables":
        return "\n".join(c.tables())
    elif a.command == "search":
        pages = spark.read.parquet(a.pages)
        pages = corpus.latest_pages(pages, at="crawled_at" if "crawled_at" in pages.columns else None)
        found = search.ranked(index.postings(pages), corpus.document_stats(pages), search.query_terms(a.query), a.max, a.limit)
        return search.to_json(found).select(F.coalesce("json", F.lit("[]"))).first()[0]
    return "OK"


def _line(row: object) -> str:
    return f"{row.key} " + " ".join(f"{k}={v}" for k, v in sorted((row.cols or {}).items()))


def main() -> None:
    from skeinwork.session import build_session

    print(run(build_session("skeinwork-cli"), sys.argv[1:]))


if __name__ == "__main__":
    main()
