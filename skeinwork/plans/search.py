"""Ranked search over postings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.text import STOP_WORDS, stem
from skeinwork.session import stage

# Fixed values of the two ranking formulas.
CANDIDATES, FIRST_WEIGHT, WEIGHT_STEP, BASE, POWER, LIMIT = 5000, 64, 4, 16.0, 8.0, 10
TFIDF_SHARE, RANK_SHARE, NO_RANK = 0.8, 0.2, 0.15


def query_terms(line: str, stemmed: bool = True, strict: bool = False) -> list[str]:
    """The terms of a query, repeats kept. ``strict``: as written, without lower-casing, stop list or length limit."""
    words = [w for w in re.split(r"\W+", line if strict else line.lower(), flags=re.ASCII) if w]
    if not strict:
        words = [w for w in words if re.fullmatch("[a-z]{3,}", w) and w not in STOP_WORDS]
    return [stem(w) for w in words] if stemmed else words


def _terms(spark: SparkSession, words: list[str]) -> DataFrame:
    """Distinct terms with ``times``: as many rows as the query has words, so a broadcast is bounded by the query."""
    return F.broadcast(spark.createDataFrame([(w, words.count(w)) for w in sorted(set(words))], "word string, times int"))


def ranked(postings: DataFrame, stats: DataFrame, words: list[str], bound: float | None = None, limit: int | None = LIMIT, candidates: int | None = CANDIDATES) -> DataFrame:
    """Pages with any of the terms by the product of their terms' weights: ``url``, ``title``, ``description``, ``score``.

    With N postings of a term, its weight on a page is (16 + sum over fields of count / sqrt(1 + words of the field)) to the power
    8 / (1 + ln N); a repeated term multiplies again and doubles N. Up to ``candidates`` pages take part (None: all), by counts weighted 64,
    16, 4 for the fields that the term has. ``stats``: ``url``, ``title``, ``description``, ``desc_words``, ``body_words``, one row a page. ``bound``: only
    scores below it (the last score of a page of results leads to the next one). Ties come in the order of urls.
    """
    spark = postings.sparkSession
    # four steps need the postings of the terms; the index is read once
    hits = stage(postings.where(F.col("word").isin(*sorted(set(words))) if words else F.lit(False)).join(_terms(spark, words), "word"), "hits")
    fields = hits.select("word", "field").distinct().groupBy("word").agg(F.array_sort(F.collect_list("field")).alias("fields"))
    sizes = hits.groupBy("word").agg(F.sum("times").alias("n"))
    # two rows of figures a term: as small as the query
    terms = F.broadcast(fields.join(sizes, "word"))
    hits = hits.join(terms, "word")
    mult = F.lit(FIRST_WEIGHT) / F.pow(F.lit(WEIGHT_STEP), F.array_position("fields", F.col("field")) - 1)
    docs = stats
    if candidates is not None:
        heavy = hits.groupBy("url").agg(F.sum(F.floor(mult) * F.col("cnt") * F.col("times")).alias("weight")).orderBy(F.desc("weight"), "url").limit(candidates).select("url")
        # at most `candidates` rows
        docs = F.broadcast(stats.join(F.broadcast(heavy), "url"))
    words_of_field = F.when(F.col("field") == 2, F.col("desc_words")).when(F.col("field") == 3, F.col("body_words")).otherwise(0)
    parts = hits.join(docs, "url").withColumn("w", F.col("cnt") / F.sqrt(1 + F.coalesce(words_of_field, F.lit(0))))
    weights = parts.groupBy("url", "word", "n", "times", "title", "description").agg((BASE + F.sum("w")).alias("w"))
    logs = F.col("times") * POWER / (1 + F.log("n")) * F.log("w")
    out = weights.groupBy("url").agg(F.first("title").alias("title"), F.first("description").alias("description"), F.exp(F.sum(logs)).alias("score"))
    if bound is not None:
        out = out.where(F.col("score") < bound)
    out = out.orderBy(F.desc("score"), "url")
    return out.limit(limit) if limit is not None else out


def blended(postings: DataFrame, stats: DataFrame, ranks: DataFrame, line: str) -> DataFrame:
    """Pages by 0.8 * tf-idf + 0.2 * page rank, summed over the terms with their share of the query: ``url``, ``title``, ``description``,
    ``score``.

    tf is a term's count over all fields by the words of description and body, idf the logarithm of pages by pages with the
    term. A page without a rank has 0.15, the least that a page can have; pages without words are left out.
    """
    spark = postings.sparkSession
    words = line.split(" ")
    hits = postings.where(F.col("word").isin(*sorted(set(words)))).join(_terms(spark, words), "word").groupBy("word", "times", "url").agg(F.sum("cnt").alias("cnt"))
    hits = stage(hits, "hits")
    df = F.broadcast(hits.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    n = stats.count()
    length = F.coalesce("desc_words", F.lit(0)) + F.coalesce("body_words", F.lit(0))
    rows = hits.join(df, "word").join(stats.withColumn("length", length).where("length > 0"), "url").join(ranks, "url", "left")
    tfidf = F.col("cnt") / F.col("length") * F.log(F.lit(float(max(n, 1))) / F.col("df"))
    part = (TFIDF_SHARE * tfidf + RANK_SHARE * F.coalesce("rank", F.lit(NO_RANK))) * F.col("times") / len(words)
    return rows.groupBy("url").agg(F.coalesce(F.first("title"), F.first("url")).alias("title"), F.first("description").alias("description"), F.sum(part).alias("score")).orderBy(F.desc("score"), "url")


def to_json(results: DataFrame) -> DataFrame:
    """One row ``json``: the results as an array in their order, null fields left out. For one page of results."""
    packed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("url").alias("k"), F.struct("url", "title", "description", "score").alias("r"))))
    return results.agg(F.to_json(F.transform(packed, lambda x: x.r)).alias("json"))


def cached_page(pages: DataFrame, url: str) -> DataFrame:
    """The stored page of a URL, found by its key."""
    return pages.where(F.col("url_hash") == F.sha1(F.lit(url))).select("page")
