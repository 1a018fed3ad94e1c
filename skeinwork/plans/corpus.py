"""From fetched pages to clean pages, link graph and document statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import html
from skeinwork.functions.text import token_count
from skeinwork.functions.urls import normal_url, resolve, url_key


def latest_pages(crawl: DataFrame, url: str = "url", page: str = "page", at: str | None = "crawled_at") -> DataFrame:
    """``url``, ``page``: of each URL the page fetched last; URLs without any page are left out.

    One pass over the pages and one shuffle of them by URL, which spreads the work of what reads them and which later steps by URL
    share. Each task keeps only the newest row of a URL before the shuffle, so a URL with many rows is no hot key.
    """
    rows = crawl.where(F.col(page).isNotNull() & F.col(url).isNotNull())
    rows = rows.select(F.col(url).alias("url"), F.col(page).alias("page"), (F.col(at) if at else F.lit(0)).alias("at"))
    newest = Window.partitionBy("url").orderBy(F.desc("at"), F.desc("page"))
    return rows.withColumn("n", F.row_number().over(newest)).where("n = 1").select("url", "page")


def clean(pages: DataFrame) -> DataFrame:
    """``url_hash``, ``url``, ``page`` without scripts."""
    return pages.where("page IS NOT NULL").select(url_key(F.col("url")).alias("url_hash"), "url", html.without_scripts(F.col("page")).alias("page"))


def page_links(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``: the distinct outlinks of each page in normal form; no row for a page without any.

    Links are resolved as rows, in compiled code, each distinct target of a page once.
    """
    hrefs = pages.select("url", F.explode(F.array_distinct(html.hrefs(F.col("page")))).alias("href"))
    return hrefs.select(F.col("url").alias("src"), normal_url(resolve(F.col("url"), F.col("href"))).alias("dst")).where("dst IS NOT NULL").distinct()


def link_graph(pages: DataFrame) -> DataFrame:
    """``url``, ``links``: the distinct outlinks of each page in normal form, in ascending order."""
    hrefs = pages.select("url", F.explode_outer(F.array_distinct(html.hrefs(F.col("page")))).alias("href"))
    found = hrefs.select("url", normal_url(resolve(F.col("url"), F.col("href"))).alias("dst"))
    return found.groupBy("url").agg(F.array_sort(F.collect_set("dst")).alias("links"))


def edges(graph: DataFrame) -> DataFrame:
    """``src``, ``dst``: one row per link."""
    return graph.select(F.col("url").alias("src"), F.explode("links").alias("dst"))


def document_stats(pages: DataFrame) -> DataFrame:
    """``url``, ``title``, ``description`` and the number of indexed words in description and body."""
    page = F.col("page")
    described = html.description(page)
    return pages.select("url", html.title(page).alias("title"), described.alias("description"), token_count(described).alias("desc_words"), token_count(html.body_text(page)).alias("body_words"))


def canonical_urls(pages: DataFrame) -> DataFrame:
    """``url``, ``canonical_url``: the least URL with the same page, byte by byte; a page's own URL if it is the first.

    Pages are compared by a 256-bit digest, so that bodies stay out of the shuffle.
    """
    digests = pages.select("url", F.sha2("page", 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("url").alias("canonical_url"), F.count(F.lit(1)).alias("n"))
    return digests.join(first.where("n > 1").select("digest", "canonical_url"), "digest", "left").select("url", F.coalesce("canonical_url", "url").alias("canonical_url"))
