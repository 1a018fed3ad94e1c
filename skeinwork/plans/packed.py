"""Queries of the problems "several values in one field" and "a few keys holding most records"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators.quantiles import grouped_quantiles
from skeinwork.operators.unpack import LINK, POSTING, unpack_values
from skeinwork.plans import sql
from skeinwork.session import stage
from skeinwork.sources.tables import normal_word, table

PROBS = (0.5, 0.9, 0.99, 1.0)
HOT_SHARE = 0.02


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Every value of graph.link and of the two posting fields, one per row."""
    graph = unpack_values(table(spark, root, "graph"), "link", ["url_hash"], LINK)
    # whole rows of graph are repeated; frag_id is unique, so postings need no shuffle
    parts = [graph.select(F.lit("graph").alias("source_table"), F.col("url_hash").alias("row_id"), F.lit("link").alias("field_name"), "pos", "item").distinct()]
    index = table(spark, root, "inv_index")
    for field in ("priority1", "priority3"):
        rows = unpack_values(index, field, ["frag_id"], POSTING)
        parts.append(rows.select(F.lit("inv_index").alias("source_table"), F.col("frag_id").cast("string").alias("row_id"), F.lit(field).alias("field_name"), "pos", "item"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _body_postings(spark: SparkSession, root: str) -> DataFrame:
    index = table(spark, root, "inv_index").select(normal_word("word").alias("word"), "priority3")
    return unpack_values(index, "priority3", ["word"], POSTING)


def p3_word_quantiles(spark: SparkSession, root: str) -> DataFrame:
    """Per word: its postings in priority3 and exact quantiles of their counts."""
    q = grouped_quantiles(_body_postings(spark, root), "word", "count", PROBS)
    named = [F.col("quantiles")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(PROBS)]
    return q.where("key IS NOT NULL").select(F.col("key").alias("word"), F.col("n_rows").alias("n_postings"), *named)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The words with at least 2 % of all postings in priority3."""
    q = stage(grouped_quantiles(_body_postings(spark, root), "word", "count", PROBS), "word-quantiles")
    total = q.agg(F.sum("n_rows")).first()[0] or 0
    return q.where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(HOT_SHARE * total))).select(F.col("key").alias("word"))


def p3_price_quantiles(spark: SparkSession, root: str) -> DataFrame:
    """Exact quantiles of the extended price, a double, of every return flag: values wide enough for eight levels."""
    rows = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    q = grouped_quantiles(rows, "flag", "l_extendedprice", PROBS)
    return q.select(F.col("key").alias("flag"), "n_rows", *[F.col("quantiles")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(PROBS)])


QUERIES = {"p3_price_quantiles": p3_price_quantiles, "p6_found": p6_found, "p3_found": p3_found, "p3_word_quantiles": p3_word_quantiles}

_LINKS = f"SELECT DISTINCT url_hash, {sql.values('link')} AS items FROM graph WHERE link IS NOT NULL"


def _field_sql(field: int) -> str:
    items = f"SELECT frag_id, {sql.values(f'priority{field}')} AS items FROM inv_index WHERE priority{field} IS NOT NULL"
    flat = f"SELECT frag_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM ({items})"
    url, count = f"nullif(regexp_extract(item, '{sql.POSTING}', 1), '')", f"regexp_extract(item, '{sql.POSTING}', 2)"
    return f"SELECT 'inv_index' AS source_table, CAST(frag_id AS VARCHAR) AS row_id, 'priority{field}' AS field_name, CAST(pos AS INT) AS pos, coalesce({url} || '@!#' || {count}, item) AS item FROM ({flat})"


SQL = {
    "p6_found": f"SELECT DISTINCT 'graph' AS source_table, url_hash AS row_id, 'link' AS field_name, CAST(generate_subscripts(items, 1) - 1 AS INT) AS pos, unnest(items) AS item FROM ({_LINKS}) UNION ALL {_field_sql(1)} UNION ALL {_field_sql(3)}",
    "p3_found": f"SELECT word FROM ({sql.postings(3)}) GROUP BY word HAVING word IS NOT NULL AND count(*) >= {HOT_SHARE} * (SELECT count(*) FROM ({sql.postings(3)}))",
    "p3_price_quantiles": "SELECT l_returnflag AS flag, count(*) AS n_rows, "
    + ", ".join(f"list_sort(list(l_extendedprice))[CAST(greatest(1, ceil({p} * count(l_extendedprice) - 1e-9)) AS BIGINT)] AS q{round(100 * p)}" for p in PROBS)
    + " FROM lineitem GROUP BY l_returnflag",
    "p3_word_quantiles": f"SELECT word, count(*) AS n_postings, "
    + ", ".join(f"list_sort(list(cnt) FILTER (cnt IS NOT NULL))[CAST(greatest(1, ceil({p} * count(cnt) - 1e-9)) AS BIGINT)] AS q{round(100 * p)}" for p in PROBS)
    + f" FROM ({sql.postings(3)}) WHERE word IS NOT NULL GROUP BY word",
}
