"""The main body of pages, as lines or as text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.pagetree import Page, article_segments, line_contexts
from skeinwork.llm.words import pieces
from skeinwork.session import spread, stage

#: Share of pages (and least number of them) that have a line before it is furniture.
RECURS, LEAST_PAGES = 0.003, 12


def recurring_lines(df: DataFrame, page_column: str, by_line: bool) -> DataFrame:
    """``shape`` of the lines that recur all over the pages: share rows, notices, promotions, heads of comments and the like.

    A line recurs if its shape (``line_shape``) stands behind at least ``RECURS`` of the number of pages different lines: an article that
    is mirrored on any number of pages brings its lines in one context only. Counts are combined before they are shuffled, and cover all
    pages; at most (mean lines of a page) / ``RECURS`` shapes come out, however many pages there are. ``by_line``: lines end at line feeds
    as well as with their element. Of less than ``LEAST_PAGES`` pages nothing can be learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (part for b in batches for part in pieces(b, 0)):
            found: set[tuple[int, int]] = set()
            for source in batch.column(0).to_pylist():
                found |= line_contexts(Page(source, by_line))
            rows = [(*x, 0) for x in found] + [(None, None, batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["shape", "before", "pages"])

    rows = spread(df.where(df[page_column].isNotNull()).select(df[page_column])).mapInArrow(run, "shape bigint, before bigint, pages bigint")
    return often(rows)


def often(rows: DataFrame) -> DataFrame:
    """``shape`` of the lines that recur, from their contexts (``shape``, ``before``) and the number of ``pages`` (in rows without a shape)."""
    contexts = rows.groupBy("shape", "before").agg(F.sum("pages").alias("pages"))
    counts = stage(contexts.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.sum("pages").alias("pages")), "line-shapes")
    pages = counts.where("shape IS NULL").agg(F.sum("pages")).first()[0] or 0
    return counts.where(F.col("shape").isNotNull() & (F.col("n") >= max(LEAST_PAGES, RECURS * pages))).select("shape")


def shapes_of(recurring: DataFrame) -> list[int]:
    """The shapes, on the driver: their number is bounded by how they were found."""
    return sorted(recurring.toArrow().column(0).to_pylist())


def _sent(recurring: DataFrame) -> Broadcast:
    return recurring.sparkSession.sparkContext.broadcast(frozenset(shapes_of(recurring)))


def body_lines(df: DataFrame, id_column: str, page_column: str, recurring: DataFrame) -> DataFrame:
    """``id``, ``line_no``: the lines (from 0, split at line feeds) of each page that hold visible text of its main body,
    without the ``recurring`` ones (``recurring_lines`` of the same or of more pages).

    A narrow pass over the pages, whole ones. Defined results: null and empty pages, and pages without text, give no
    lines; repeated records give repeated rows; unclosed and unopened elements are read as browsers read them; a null id
    stays null; other columns are ignored.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), T.StructField("line_no", T.IntegerType())])
    furniture = _sent(recurring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (part for b in batches for part in pieces(b, 1)):
            rows, lines = [], []
            for i, source in enumerate(batch.column(1).to_pylist()):
                if source:
                    page = Page(source, True)
                    found = sorted({page.segments[k].line for k in article_segments(page, furniture.value)})
                    rows += [i] * len(found)
                    lines += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int32())], names=schema.names)

    return spread(df.select(df[id_column], df[page_column])).mapInArrow(run, schema)


def body_text(df: DataFrame, id_column: str, page_column: str, recurring: DataFrame) -> DataFrame:
    """``id``, ``body``: the text of each page's main body, one paragraph, heading or item a line, without the ``recurring`` ones.

    Works on pages of any layout, minified ones too. Null and empty pages, and pages without text, have an empty body;
    otherwise as ``body_lines``.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), T.StructField("body", T.StringType())])
    furniture = _sent(recurring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (part for b in batches for part in pieces(b, 1)):
            texts = []
            for source in batch.column(1).to_pylist():
                page = Page(source or "", False)
                texts.append("\n".join(page.segments[k].text for k in article_segments(page, furniture.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return spread(df.select(df[id_column], df[page_column])).mapInArrow(run, schema)
