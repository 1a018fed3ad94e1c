"""Structured Streaming over the corpus: postings that grow with arriving pages, URLs seen before, fetches by host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinwork.plans.index import postings


def index_stream(pages: DataFrame, path: str, checkpoint: str, stemmed: bool = True) -> StreamingQuery:
    """Appends the postings of each micro-batch of ``pages`` (``url``, ``page``) to the Parquet folder ``path``, by batch.

    A batch that is run again writes its own folder anew, so postings are kept once whatever fails. Runs over what is there
    and ends.
    """

    def add(batch: DataFrame, number: int) -> None:
        postings(batch, stemmed).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/run={number}")

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(urls: DataFrame, at: str, lateness: str = "1 hour") -> DataFrame:
    """The first event of each URL; the state of a URL is dropped once the watermark has passed it."""
    return urls.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["url"])


def fetches_by_host(events: DataFrame, at: str, window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Fetches of each host in windows of event time; late rows count until the watermark passes their window."""
    rows = events.withWatermark(at, lateness).groupBy(F.window(at, window), "host").agg(F.count(F.lit(1)).alias("fetches"))
    return rows.select("host", F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "fetches")
