"""PageRank with a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.session import partitioned, stage

ROUNDS, DAMPING = 10, 0.85
#: Rounds between writes to the shared folder.
STRETCH = 5


def pagerank(graph: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``url``, ``rank`` of every page of ``graph`` (``url``, ``links``), one row per page.

    All ranks begin at 1; in each round a page passes rank / number of its links along every link, and a page's rank
    becomes damping * what it got + 1 - damping. Links to pages outside of the graph take their share with them.

    A page's links stay one row (no skew by source), sums combine on the map side (no skew by target), and every few rounds
    ranks are written to the shared folder, so plans stay short and a lost executor costs few rounds. The links are
    partitioned once; a round moves sums only, ranks stay where their links are.
    """
    pages = partitioned(stage(graph.where("url IS NOT NULL").select("url", "links"), "pages"), "url")
    ranks = pages.select("url", F.lit(1.0).alias("rank"))
    if not rounds:
        return stage(ranks, "ranks")
    for i in range(1, rounds + 1):
        share = F.col("rank") / F.size("links")
        sent = pages.where("size(links) > 0").join(ranks, "url").select(F.explode("links").alias("url"), share.alias("got"))
        sums = sent.groupBy("url").agg(F.sum("got").alias("got"))
        ranks = pages.select("url").join(sums, "url", "left").select("url", (F.lit(damping) * F.coalesce("got", F.lit(0.0)) + F.lit(1 - damping)).alias("rank"))
        if i % STRETCH == 0 or i == rounds:
            ranks = stage(ranks, "ranks")
    pages.unpersist()
    return ranks
