"""The crawl as a replay over pages that are already known: frontier rounds, robots rules, content duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.urls import normal_url, robots_delay_udf
from skeinwork.operators.ranking import running_sum
from skeinwork.plans.corpus import page_links
from skeinwork.session import extent, partitioned, stage

MAX_DEPTH, MAX_URL = 15, 300


def allowed(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """``urls`` (with ``url``, ``host``) that the robots rules of their host let in, with ``delay_ms`` between fetches.

    Hosts without rules, and unknown hosts, let everything in.
    """
    rules = hosts.groupBy("host").agg(F.max("robots").alias("robots"))
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*(/[^?#]*)?", 1)
    rows = urls.join(rules, "host", "left").withColumn("delay_ms", robots_delay_udf("robots", F.when(path == "", "/").otherwise(path)))
    return rows.where("delay_ms IS NOT NULL").drop("robots")


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int = MAX_DEPTH, blocked: Sequence[str] = (), max_url: int | None = MAX_URL) -> DataFrame:
    """``url``, ``depth``: every page within reach of ``seeds`` (``url``) along ``links`` (``src``, ``dst``), with its least number of steps.

    Breadth first, one round for each depth: the newest pages meet their links (partitioned once), known pages are taken out by an anti join,
    and each round is written to the shared folder. URLs longer than ``max_url`` (None: none) and URLs with a piece of ``blocked`` in them are not followed.
    """
    fit = F.length("url") <= max_url if max_url is not None else F.lit(True)
    for piece in blocked:
        fit &= ~F.col("url").contains(piece)
    links = partitioned(stage(links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "links"), "src")
    newest = stage(seeds.select("url").where("url IS NOT NULL").where(fit).distinct().withColumn("depth", F.lit(0)), "round")
    seen = newest
    for depth in range(1, max_depth + 1):
        reached = newest.select(F.col("url").alias("src")).join(links, "src").select(F.col("dst").alias("url")).where(fit).distinct()
        newest = stage(reached.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "round")
        if not extent(newest)[0]:
            break
        seen = seen.unionByName(newest)
    links.unpersist()
    return seen


def replay(seeds: DataFrame, pages: DataFrame, hosts: DataFrame, max_depth: int = MAX_DEPTH, blocked: Sequence[str] = (), max_url: int | None = MAX_URL) -> DataFrame:
    """A crawl in rounds over known fetch results: ``url``, ``depth``, ``delay_ms``, ``canonical_url`` of every URL that gets fetched.

    ``pages``: ``url``, ``host``, ``response_code``, ``lang``, ``page``. A round takes the frontier's new URLs that the robots rules allow,
    looks up their results, and follows the links of HTML pages with code 200, in English or of unknown language. A page
    that equals one fetched before, byte by byte, names that one's URL as ``canonical_url`` and its links are not followed; within
    a round the least URL goes first. Links are followed in the form in which ``pages`` has their URL.
    """
    fit = F.length("url") <= max_url if max_url is not None else F.lit(True)
    for piece in blocked:
        fit &= ~F.col("url").contains(piece)
    known = pages.where("url IS NOT NULL").groupBy("url").agg(F.max(F.struct("host", "response_code", "lang", F.sha2("page", 256).alias("digest"))).alias("f"))
    known = stage(known.select("url", "f.*"), "fetches")
    links = stage(page_links(pages.where("url IS NOT NULL AND page IS NOT NULL").select("url", "page")), "links")
    named = stage(known.select("url", normal_url(F.col("url")).alias("normal")), "names")
    todo = seeds.select("url").where("url IS NOT NULL").where(fit).distinct()
    fetched = None
    for depth in range(max_depth + 1):
        rows = todo.join(known, "url")
        rows = allowed(rows, hosts).withColumn("depth", F.lit(depth))
        # the first URL of each body: among earlier rounds, else the least of this one
        first = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("url").alias("now"))
        if fetched is not None:
            before = fetched.where("canonical_url IS NULL AND digest IS NOT NULL").select("digest", F.col("url").alias("earlier"))
            first = first.join(before, "digest", "left")
        else:
            first = first.withColumn("earlier", F.lit(None).cast("string"))
        rows = rows.join(first, "digest", "left")
        source = F.coalesce("earlier", "now")
        rows = rows.withColumn("canonical_url", F.when(source != F.col("url"), source))
        rows = stage(rows.select("url", "depth", "delay_ms", "canonical_url", "digest", "response_code", "lang"), "round")
        if not extent(rows)[0]:
            break
        fetched = rows if fetched is None else fetched.unionByName(rows)
        english = F.col("lang").isNull() | F.lower("lang").contains("en")
        follow = rows.where((F.col("response_code") == "200") & F.col("canonical_url").isNull() & english).select(F.col("url").alias("src"))
        found = follow.join(links, "src").select(F.col("dst").alias("normal")).distinct().join(named, "normal").select("url").where(fit).distinct()
        todo = stage(found.join(fetched.select("url"), "url", "left_anti"), "frontier")
    if fetched is None:
        return seeds.sparkSession.createDataFrame([], "url string, depth int, delay_ms bigint, canonical_url string")
    return fetched.select("url", "depth", "delay_ms", "canonical_url")


def polite_schedule(fetches: DataFrame) -> DataFrame:
    """``fetches`` (``url``, ``host``, ``depth``, ``delay_ms``) with ``start_ms``: when each can begin, from 0 on for every host, if a host's fetches
    keep its delay, shallow ones first."""
    return running_sum(fetches.where("host IS NOT NULL"), ["host"], [F.col("depth"), F.col("url")], F.col("delay_ms"), "start_ms")
