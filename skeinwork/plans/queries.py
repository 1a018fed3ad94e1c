"""Registered queries of the dataflow algebra, the store, the corpus pipeline, search and crawl, each with its SQL form."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import html, urls
from skeinwork.functions.text import exploded_tokens, stem_udf
from skeinwork.operators.dataflow import Context, Pairs, Values
from skeinwork.plans import corpus, crawl, index, pagerank, search, sql
from skeinwork.session import drop_later, stage, staging_root
from skeinwork.sources import store
from skeinwork.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL form if it has one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return keep


def _values(spark: SparkSession, root: str, name: str, column: str) -> Values:
    return Context(spark).from_table(table(spark, root, name), F.col(column).cast("string"))


def _pairs(spark: SparkSession, root: str, name: str, key: str, value: str) -> Pairs:
    df = table(spark, root, name)
    return Pairs(df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).where("key IS NOT NULL AND value IS NOT NULL"))


# -- dataflow


@query()
def parallelize_values(spark: SparkSession, root: str) -> DataFrame:
    return Context(spark).parallelize(["b", "a", "c", "a"]).df


SQL["parallelize_values"] = "SELECT unnest(['b', 'a', 'c', 'a']) AS value"


@query("SELECT o_orderkey || ',' || o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def from_table_project(spark: SparkSession, root: str) -> DataFrame:
    return Context(spark).from_table(table(spark, root, "orders"), F.concat(F.col("o_orderkey").cast("string"), F.lit(","), "o_orderpriority")).df


@query("SELECT r_name || '/' || r_regionkey AS value FROM region")
def from_table_python(spark: SparkSession, root: str) -> DataFrame:
    return Context(spark).from_table(table(spark, root, "region"), lambda r: f"{r['r_name']}/{r['r_regionkey']}").df


@query("SELECT o_orderpriority AS value FROM orders WHERE starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '5')")
def filter_rows(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "orders", "o_orderpriority").filter(F.col("value").startswith("1") | F.col("value").startswith("5")).df


@query("SELECT o_orderpriority AS value FROM orders WHERE length(o_orderpriority) > 6")
def filter_python(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "orders", "o_orderpriority").filter(lambda v: len(v) > 6).df


@query("SELECT unnest(list_filter(string_split_regex(lower(text), '\\W+'), lambda w: w <> '')) AS value FROM documents")
def flatmap_tokens(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "documents", "text").flat_map(F.filter(F.split(F.lower("value"), r"\W+"), lambda w: w != "")).df


@query("SELECT unnest(string_split(c_name, '#')) AS value FROM customer")
def flatmap_python(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "customer", "c_name").flat_map(lambda v: v.split("#")).df


@query("SELECT unnest(string_split(c_name, '#')) AS value FROM customer")
def flatmap_shuffled(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "customer", "c_name").flat_map_shuffled(lambda v: v.split("#")).df


@query("SELECT left(n_name, 1) AS key, substring(n_name, 2) AS value FROM nation")
def map_to_pair(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "nation", "n_name").map_to_pair(F.substring("value", 1, 1), F.expr("substring(value, 2)")).df


@query("SELECT left(n_name, 1) AS key, substring(n_name, 2) AS value FROM nation")
def map_to_pair_python(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "nation", "n_name").map_to_pair(lambda v: (v[:1], v[1:])).df


@query("SELECT w AS key, CAST(length(w) AS VARCHAR) AS value FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")
def flatmap_to_pair(spark: SparkSession, root: str) -> DataFrame:
    pairs = F.transform(F.split("value", " "), lambda w: F.struct(w.alias("k"), F.length(w).alias("v")))
    return _values(spark, root, "part", "p_name").flat_map_to_pair(pairs).df


@query("SELECT unnest([c_mktsegment, c_name]) AS value FROM customer WHERE c_mktsegment IS NOT NULL AND c_name IS NOT NULL")
def pair_flatmap(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "customer", "c_mktsegment", "c_name").flat_map(F.array("key", "value")).df


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL AND c_name IS NOT NULL")
def pair_swap(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "customer", "c_mktsegment", "c_name").flat_map_to_pair(lambda k, v: [(v, k)]).df


@query("SELECT left(p_name, 1) AS key, p_name AS value FROM part")
def key_by(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "part", "p_name").key_by(F.substring("value", 1, 1)).df


@query("SELECT right(c_name, 1) AS key, string_agg(c_name, ',' ORDER BY c_name) AS value FROM customer GROUP BY 1")
def group_concat(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "customer", "c_name").group_concat(F.expr("right(value, 1)")).df


@query("SELECT key, CAST(part AS INT) AS part, count(*) AS n, string_agg(c_name, ',' ORDER BY c_name) AS value FROM (SELECT c_name, c_mktsegment AS key, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) - 1) // 100 AS part FROM customer) GROUP BY key, part")
def group_parts(spark: SparkSession, root: str) -> DataFrame:
    """Groups as lists of at most a hundred elements, however large the group is."""
    rows = table(spark, root, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("value"))
    return Pairs(rows).wide_parts(100).withColumn("value", F.array_join("values", ",")).drop("values")


@query(
    """WITH b AS (SELECT CAST(c_nationkey AS VARCHAR) AS key, 0 AS side, CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 1, CAST(s_suppkey AS VARCHAR) FROM supplier)
    SELECT key, side, CAST(part AS INT) AS part, count(*) AS n, string_agg(v, ',' ORDER BY v) AS value FROM (SELECT *, (row_number() OVER (PARTITION BY key, side ORDER BY v) - 1) // 20 AS part FROM b) GROUP BY key, side, part"""
)
def cogroup_parts(spark: SparkSession, root: str) -> DataFrame:
    out = _pairs(spark, root, "customer", "c_nationkey", "c_custkey").cogroup_parts(_pairs(spark, root, "supplier", "s_nationkey", "s_suppkey"), 20)
    return out.withColumn("value", F.array_join("values", ",")).drop("values")


@query("SELECT event_type || '!' AS value FROM events WHERE event_type IS NOT NULL")
def map_partitions_tag(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "events", "event_type").map_partitions(lambda it: (v + "!" for v in it)).df


@query()
def sample_bernoulli(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "orders", "o_orderkey").sample(0.1, seed=7).df


@query()
def take_n(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "orders", "o_orderkey").df.limit(5)


@query("SELECT count(*) AS n_all, true AS near, true AS part FROM orders")
def sample_share(spark: SparkSession, root: str) -> DataFrame:
    """Whether a sample of a half has about the half of the elements (six standard deviations) and only elements of the whole."""
    whole = _values(spark, root, "orders", "o_orderkey")
    some = whole.sample(0.5, seed=3).df.groupBy("value").agg(F.count(F.lit(1)).alias("s"))
    both = whole.df.groupBy("value").agg(F.count(F.lit(1)).alias("n")).join(some, "value", "full").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s"))
    near = F.abs(F.sum("s") - F.sum("n") / 2) <= 3 * F.sqrt(F.sum("n").cast("double"))
    return both.agg(F.sum("n").alias("n_all"), near.alias("near"), (F.max(F.col("s") - F.col("n")) <= 0).alias("part"))


@query("SELECT least(5, count(*)) AS n, least(5, count(*)) AS known FROM orders")
def take_known(spark: SparkSession, root: str) -> DataFrame:
    """How many elements ``take`` gives, and how many of these the whole has."""
    whole = _values(spark, root, "orders", "o_orderkey")
    got = spark.createDataFrame([(v,) for v in whole.take(5)], "value string")
    return got.join(whole.df.select("value", F.lit(1).alias("k")), "value", "left").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("known"))


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL AND c_name IS NOT NULL")
def pair_count(spark: SparkSession, root: str) -> DataFrame:
    return spark.range(1).select(F.lit(_pairs(spark, root, "customer", "c_nationkey", "c_name").count()).cast("bigint").alias("n"))


@query("SELECT DISTINCT l_shipdate::DATE::VARCHAR AS value FROM lineitem")
def distinct_values(spark: SparkSession, root: str) -> DataFrame:
    return Context(spark).from_table(table(spark, root, "lineitem"), F.col("l_shipdate").cast("date").cast("string")).distinct().df


@query("SELECT CAST(l_partkey AS VARCHAR) AS value FROM lineitem INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def intersection_keys(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "lineitem", "l_partkey").intersection(_values(spark, root, "orders", "o_custkey")).df


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def union_values(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "nation", "n_name").union(_values(spark, root, "region", "r_name")).df


@query("SELECT CAST(c_nationkey AS VARCHAR) AS value FROM customer EXCEPT ALL SELECT CAST(s_nationkey AS VARCHAR) FROM supplier")
def subtract_values(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "customer", "c_nationkey").subtract(_values(spark, root, "supplier", "s_nationkey")).df


@query("SELECT count(*) AS n FROM lineitem WHERE l_linestatus IS NOT NULL")
def count_all(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "lineitem", "l_linestatus").aggregate(F.count(F.lit(1))).withColumnRenamed("value", "n")


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem")
def fold_total(spark: SparkSession, root: str) -> DataFrame:
    return _values(spark, root, "lineitem", "l_quantity").aggregate(F.sum(F.col("value").cast("double").cast("bigint")))


@query("SELECT CAST(sum(n_nationkey) AS VARCHAR) AS value FROM nation")
def fold_python(spark: SparkSession, root: str) -> DataFrame:
    total = _values(spark, root, "nation", "n_nationkey").fold("0", lambda a, b: str(int(a) + int(b)))
    return Context(spark).parallelize([total]).df


@query("SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS VARCHAR) AS value FROM lineitem GROUP BY l_suppkey")
def fold_by_key_sum(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "lineitem", "l_suppkey", "l_quantity").fold_by_key_with(F.sum(F.col("value").cast("double").cast("bigint"))).df


@query("SELECT CAST(s_nationkey AS VARCHAR) AS key, CAST(sum(s_suppkey) AS VARCHAR) AS value FROM supplier GROUP BY 1")
def fold_by_key_python(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "supplier", "s_nationkey", "s_suppkey").fold_by_key("0", lambda a, b: str(int(a) + int(b)), commutative=True).df


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, string_agg('+' || n_name, '' ORDER BY n_name) AS value FROM nation GROUP BY 1")
def fold_by_key_ordered(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "nation", "n_regionkey", "n_name").fold_by_key("", lambda a, b: f"{a}+{b}").df


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ',' || o_orderkey AS value FROM customer JOIN orders ON c_custkey = o_custkey")
def join_pairs(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "customer", "c_custkey", "c_name").join(_pairs(spark, root, "orders", "o_custkey", "o_orderkey")).df


@query(
    """WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS key, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS v FROM customer GROUP BY 1),
    b AS (SELECT CAST(s_nationkey AS VARCHAR) AS key, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS v FROM supplier GROUP BY 1)
    SELECT coalesce(a.key, b.key) AS key, '[' || coalesce(a.v, '') || '],[' || coalesce(b.v, '') || ']' AS value FROM a FULL JOIN b ON a.key = b.key"""
)
def cogroup_pairs(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "customer", "c_nationkey", "c_custkey").cogroup(_pairs(spark, root, "supplier", "s_nationkey", "s_suppkey")).df


def _large_orders(spark: SparkSession, root: str) -> Values:
    return Context(spark).from_table(table(spark, root, "orders").where("o_totalprice > 400000"), F.col("o_custkey"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_exists(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "customer", "c_custkey", "c_name").semi_join(_large_orders(spark, root)).df


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_missing(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, "customer", "c_custkey", "c_name").anti_join(_large_orders(spark, root)).df


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, list(n_name ORDER BY n_name)::VARCHAR AS values FROM nation GROUP BY 1")
def wide_pairs(spark: SparkSession, root: str) -> DataFrame:
    out = _pairs(spark, root, "nation", "n_regionkey", "n_name").wide()
    return out.select("key", F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")).alias("values"))


@query(f"SELECT w AS key, CAST(count(*) AS VARCHAR) AS value FROM (SELECT unnest({sql.tokens('text')}) AS w FROM documents) GROUP BY w")
def word_count(spark: SparkSession, root: str) -> DataFrame:
    words = Values(exploded_tokens(table(spark, root, "documents"), F.col("text")).withColumnRenamed("word", "value"))
    return words.map_to_pair(F.col("value"), F.lit("1")).fold_by_key_with(F.count(F.lit(1))).df


@query("SELECT split_part(value, '@!#', 1) AS url, CAST(min(CAST(split_part(value, '@!#', 2) AS INT)) AS INT) AS depth FROM (SELECT url || '@!#' || (doc_id % 7) AS value FROM documents WHERE url IS NOT NULL) GROUP BY 1")
def flatmap_to_frontier(spark: SparkSession, root: str) -> DataFrame:
    """Elements ``url@!#depth`` kept once for each url, at the least depth."""
    v = Context(spark).from_table(table(spark, root, "documents").where("url IS NOT NULL"), F.concat("url", F.lit("@!#"), (F.col("doc_id") % 7).cast("string")))
    parts = F.split("value", "@!#")
    return v.df.select(parts[0].alias("url"), parts[1].cast("int").alias("depth")).groupBy("url").agg(F.min("depth").alias("depth"))


# -- store


def _suppliers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").select(F.col("s_name").alias("key"), "s_nationkey", "s_acctbal")


@query("SELECT url_hash AS key, url FROM doc_word_count WHERE url_hash >= '2' AND url_hash < 'a'")
def range_scan(spark: SparkSession, root: str) -> DataFrame:
    return store.scan(table(spark, root, "doc_word_count").select(F.col("url_hash").alias("key"), "url"), "2", "a")


@query("SELECT url_hash AS key, url FROM doc_word_count WHERE url_hash >= 'd' OR url_hash < '3'")
def range_scan_wrap(spark: SparkSession, root: str) -> DataFrame:
    return store.scan(table(spark, root, "doc_word_count").select(F.col("url_hash").alias("key"), "url"), "d", "3")


@query("SELECT o_orderstatus FROM orders WHERE o_orderkey = 7")
def get_cell(spark: SparkSession, root: str) -> DataFrame:
    return store.get_cell(table(spark, root, "orders"), 7, "o_orderstatus", key="o_orderkey")


@query("SELECT * FROM customer WHERE c_custkey = 11")
def get_row(spark: SparkSession, root: str) -> DataFrame:
    return store.get_row(table(spark, root, "customer"), 11, key="c_custkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders JOIN (SELECT unnest([1::BIGINT, 5, 5, 9, -4]) AS k) ON o_orderkey = k")
def multi_get(spark: SparkSession, root: str) -> DataFrame:
    wanted = spark.createDataFrame([(k,) for k in (1, 5, 5, 9, -4)], "o_orderkey bigint")
    return store.get_rows(table(spark, root, "orders"), wanted, key="o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT DISTINCT l_orderkey, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS found FROM lineitem")
def exists_row(spark: SparkSession, root: str) -> DataFrame:
    finished = table(spark, root, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.exists(finished, table(spark, root, "lineitem"), key="l_orderkey")


@query("SELECT url, max_by(current_score, struct_pack(a := computed_at, b := current_score)) AS current_score, CAST(epoch(max(computed_at)) AS BIGINT) AS computed_at FROM pageranks WHERE current_score IS NOT NULL GROUP BY url")
def latest_per_key(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "pageranks").where("current_score IS NOT NULL")
    return store.latest(rows, ["url"], F.struct("computed_at", "current_score")).select("url", "current_score", F.unix_timestamp("computed_at").alias("computed_at"))


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE CAST(n_regionkey AS VARCHAR) END AS region
    FROM nation UNION ALL SELECT '99', NULL, 'new'"""
)
def put_cell(spark: SparkSession, root: str) -> DataFrame:
    nation = table(spark, root, "nation")
    generic = nation.select(F.col("n_nationkey").cast("string").alias("key"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("cols"))
    puts = nation.where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("key"), F.lit("region").alias("column"), F.inline(F.array(F.struct(F.lit("tmp").alias("value"), F.lit(1).alias("seq")), F.struct(F.lit("moved").alias("value"), F.lit(2).alias("seq")))))
    puts = puts.unionByName(spark.createDataFrame([("99", "region", "new", 1)], "key string, column string, value string, seq int"))
    return store.put_cells(generic, puts).select("key", F.col("cols")["name"].alias("name"), F.col("cols")["region"].alias("region"))


@query("SELECT s_name AS key, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT s_name, -1, 0.0 FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'new', 0, 1.5")
def put_row(spark: SparkSession, root: str) -> DataFrame:
    old = _suppliers(spark, root)
    rows = old.where("s_nationkey = 3").select("key", F.lit(-1).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    rows = rows.unionByName(spark.createDataFrame([("new", 0, 1.5)], "key string, s_nationkey int, s_acctbal double"))
    return store.put_rows(old, rows)


@query(
    """WITH a AS (SELECT c_mktsegment AS key, string_agg(c_name, ',' ORDER BY c_name) AS v FROM customer WHERE c_nationkey < 5 GROUP BY 1),
    b AS (SELECT c_mktsegment AS key, string_agg(c_name, ',' ORDER BY c_name) AS v FROM customer WHERE c_nationkey >= 20 GROUP BY 1)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE a.v || '@@!!##' || b.v END AS v FROM a FULL JOIN b ON a.key = b.key"""
)
def append_merge(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "customer")
    part = lambda cond: rows.where(cond).groupBy(F.col("c_mktsegment").alias("key")).agg(F.array_join(F.array_sort(F.collect_list("c_name")), ",").alias("v"))
    return store.append_rows(part("c_nationkey < 5"), part("c_nationkey >= 20"), ["v"])


@query("SELECT url_hash, left(url, 500) AS url FROM doc_word_count WHERE url_hash >= '7' ORDER BY url_hash, url LIMIT 11")
def table_view_page(spark: SparkSession, root: str) -> DataFrame:
    return store.page_view(table(spark, root, "doc_word_count").select("url_hash", "url"), "7", key="url_hash")


@query("SELECT count(*) AS n FROM page_cache")
def table_count(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "page_cache").agg(F.count(F.lit(1)).alias("n"))


def _database(spark: SparkSession) -> store.Catalog:
    """A catalog of its own, whose tables lie in the shared folder."""
    name = f"skein_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{staging_root(spark)}/{name}'")
    return store.Catalog(spark, name)


def _closed(catalog: store.Catalog, result: DataFrame) -> DataFrame:
    """A result that outlives the catalog's tables."""
    out = stage(result, "result")
    catalog.spark.sql(f"DROP DATABASE {catalog.database} CASCADE")
    return out


@query("SELECT n_name AS key, n_regionkey AS region FROM nation UNION ALL SELECT 'added', 9")
def catalog_write(spark: SparkSession, root: str) -> DataFrame:
    """A table that is persisted empty, written twice and renamed."""
    c = _database(spark)
    rows = table(spark, root, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("bigint").alias("region"))
    c.persist("first", "key string, region bigint")
    c.write("first", rows)
    c.write("first", spark.createDataFrame([("added", 9)], "key string, region bigint"))
    c.rename("first", "second")
    return _closed(c, c.table("second"))


@query("SELECT * FROM (VALUES ('a', 0::BIGINT), ('b', (SELECT count(*) FROM region)), ('c', 0)) t(name, n)")
def catalog_count(spark: SparkSession, root: str) -> DataFrame:
    """Rows of an empty table, of one with rows, and of one that was deleted."""
    c = _database(spark)
    rows = table(spark, root, "region").select(F.col("r_name").alias("key"))
    c.persist("a", "key string")
    c.write("b", rows)
    c.write("c", rows)
    c.delete("c")
    return _closed(c, spark.createDataFrame([(t, c.count(t)) for t in ("a", "b", "c")], "name string, n bigint"))


@query("SELECT * FROM (VALUES ('a', 0::BIGINT, false, true), ('b', (SELECT count(*) FROM region), true, true)) t(name, n_rows, has_bytes, persistent)")
def catalog_tables(spark: SparkSession, root: str) -> DataFrame:
    """The list of tables with their size."""
    c = _database(spark)
    c.persist("a", "key string")
    c.write("b", table(spark, root, "region").select(F.col("r_name").alias("key")))
    return _closed(c, c.sizes().select("name", "n_rows", (F.col("n_bytes") > 0).alias("has_bytes"), "persistent"))


@query("SELECT url, max_by(current_score, struct_pack(a := computed_at, b := current_score)) AS current_score FROM pageranks WHERE url IS NOT NULL AND current_score IS NOT NULL GROUP BY url")
def catalog_compact(spark: SparkSession, root: str) -> DataFrame:
    """A log of ranks as a table, rewritten with the last record of each key."""
    c = _database(spark)
    c.write("log", table(spark, root, "pageranks").where("url IS NOT NULL AND current_score IS NOT NULL").select("url", "current_score", "computed_at"))
    c.compact("log", ["url"], F.struct("computed_at", "current_score"))
    return _closed(c, c.table("log").select("url", "current_score"))


@query("SELECT p_name AS value FROM part WHERE p_name IS NOT NULL UNION ALL SELECT unnest(['x', 'y', 'x'])")
def saved_values(spark: SparkSession, root: str) -> DataFrame:
    """Elements saved as a table, and given ones added to it."""
    c = _database(spark)
    name = f"{c.database}.kept"
    _values(spark, root, "part", "p_name").save_as_table(name)
    Context(spark).parallelize(["x", "y", "x"], table=name)
    return _closed(c, Context(spark).from_table(name, F.col("value")).df)


@query("SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def saved_pairs(spark: SparkSession, root: str) -> DataFrame:
    c = _database(spark)
    return _closed(c, _pairs(spark, root, "nation", "n_name", "n_regionkey").save_as_table(f"{c.database}.pairs").df)


# -- pages


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return corpus.latest_pages(table(spark, root, "crawl"))


@query(f"SELECT url, sha1(url) AS url_hash, sha1(regexp_replace(page, '{sql.SCRIPT}', '', 'g')) AS cleaned FROM ({sql.PAGES})")
def html_clean(spark: SparkSession, root: str) -> DataFrame:
    return corpus.clean(_pages(spark, root)).select("url", "url_hash", F.sha1("page").alias("cleaned"))


@query(f"SELECT url, {sql.title()} AS title FROM ({sql.PAGES})")
def html_title(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).select("url", html.title(F.col("page")).alias("title"))


@query(f"SELECT url, sha1({sql.body_text()}) AS body FROM ({sql.PAGES})")
def html_body_text(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).select("url", F.sha1(html.body_text(F.col("page"))).alias("body"))


_LINKS = f"SELECT url, list_sort(list_distinct(list_filter(list_transform({sql.hrefs()}, lambda h: {sql.normal_url(sql.resolve('url', 'h'))}), lambda u: u IS NOT NULL))) AS links FROM ({sql.PAGES})"


@query(f"SELECT url AS src, unnest(links) AS dst FROM ({_LINKS})")
def link_extract(spark: SparkSession, root: str) -> DataFrame:
    return corpus.page_links(_pages(spark, root))


@query(f"SELECT DISTINCT item AS url, {sql.normal_url('item')} AS normal FROM (SELECT unnest({sql.values('link')}) AS item FROM graph)")
def url_normalise(spark: SparkSession, root: str) -> DataFrame:
    from skeinwork.operators.unpack import unpack_values

    return unpack_values(table(spark, root, "graph"), "link", []).select(F.col("item").alias("url"), urls.normal_url(F.col("item")).alias("normal")).distinct()


@query(
    r"""SELECT DISTINCT url, regexp_extract(url, '^([^/:]*):?//', 1) AS protocol, regexp_extract(url, '//([^/:]*)', 1) AS host, nullif(regexp_extract(url, '//[^/:]*:([^/]*)', 1), '') AS port,
    coalesce(nullif(regexp_extract(url, '//[^/]*(/.*)$', 1), ''), '/') AS path FROM crawl WHERE url IS NOT NULL"""
)
def url_parse(spark: SparkSession, root: str) -> DataFrame:
    p = urls.split_url(F.col("url"))
    return table(spark, root, "crawl").where("url IS NOT NULL").select("url", p.protocol.alias("protocol"), p.host.alias("host"), p.port.alias("port"), p.path.alias("path")).distinct()


@query("SELECT DISTINCT url, url_decode(replace(replace(url, '/', '%2F'), 'a', '%61')) AS decoded FROM pages WHERE url IS NOT NULL")
def url_decoded(spark: SparkSession, root: str) -> DataFrame:
    coded = F.replace(F.replace(F.col("url"), F.lit("/"), F.lit("%2F")), F.lit("a"), F.lit("%61"))
    return table(spark, root, "pages").where("url IS NOT NULL").select("url", urls.decoded(coded).alias("decoded")).distinct()


@query("SELECT DISTINCT url, sha1(url) AS url_hash FROM pages WHERE url IS NOT NULL")
def url_hash(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").where("url IS NOT NULL").select("url", urls.url_key(F.col("url")).alias("url_hash")).distinct()


@query(
    """SELECT DISTINCT url, array_to_string(list_transform(list_transform(range(0, 20), lambda i: ('0x' || substring(sha1(url), 2 * i + 1, 2))::INT),
    lambda b: chr(CAST(97 + (CASE WHEN b = 0 THEN 255 WHEN b < 128 THEN b ELSE b - 1 END) % 26 AS INT)) || chr(CAST(97 + 2 * ((CASE WHEN b = 0 THEN 255 WHEN b < 128 THEN b ELSE b - 1 END) // 26) AS INT))), '') AS key
    FROM pages WHERE url IS NOT NULL"""
)
def url_letter_hash(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").where("url IS NOT NULL").select("url", urls.letter_hash(F.sha1("url")).alias("key")).distinct()


@query(
    """SELECT r_name, n_name, CAST(coalesce(list_max(list_filter(generate_series(0, least(length(r_name), length(n_name))), lambda i: left(r_name, i) = left(n_name, i))), 0) AS INT) AS common
    FROM region JOIN nation ON n_regionkey = r_regionkey"""
)
def common_prefix(spark: SparkSession, root: str) -> DataFrame:
    both = table(spark, root, "region").join(table(spark, root, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("r_name", "n_name", urls.common_prefix(F.col("r_name"), F.col("n_name")).cast("int").alias("common"))


@query("SELECT s_suppkey, greatest(s_nationkey, 5) AS low, least(s_nationkey + 10, 20) AS high FROM supplier WHERE greatest(s_nationkey, 5) < least(s_nationkey + 10, 20)")
def range_overlap(spark: SparkSession, root: str) -> DataFrame:
    o = urls.overlap(F.col("s_nationkey"), F.col("s_nationkey") + 10, F.lit(5), F.lit(20))
    return table(spark, root, "supplier").select("s_suppkey", o.alias("o")).where("o IS NOT NULL").select("s_suppkey", F.col("o.from").alias("low"), F.col("o.to").alias("high"))


_ROBOTS = """r AS (SELECT host, max(robots) AS robots FROM hosts GROUP BY host),
    l AS (SELECT host, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT host, string_split_regex(robots, '\\r\\n|\\n|\\r') AS ls FROM r WHERE robots IS NOT NULL)),
    p AS (SELECT host, i, lower(trim(split_part(line, ':', 1))) AS name, trim(substring(line, instr(line, ':') + 1)) AS value FROM l WHERE contains(line, ':')),
    m AS (SELECT *, last_value(CASE WHEN name = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY host ORDER BY i) AS agent FROM p),
    d AS (SELECT host, max_by(CAST(trunc(TRY_CAST(value AS DOUBLE) * 1000) AS BIGINT), i) AS delay FROM m WHERE agent = '*' AND name = 'crawl-delay' AND TRY_CAST(value AS DOUBLE) IS NOT NULL GROUP BY host),
    k AS (SELECT DISTINCT url, host, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)?', 1), ''), '/') AS path FROM crawl WHERE url IS NOT NULL),
    x AS (SELECT k.url, k.host, coalesce(max(length(value)) FILTER (name = 'allow'), -1) AS allowed, coalesce(max(length(value)) FILTER (name = 'disallow'), -1) AS denied
      FROM k LEFT JOIN m ON m.host = k.host AND agent = '*' AND name IN ('allow', 'disallow') AND value <> '' AND starts_with(path, value) GROUP BY k.url, k.host),
    a AS (SELECT url, x.host, coalesce(delay, 400) AS delay_ms FROM x LEFT JOIN d ON d.host = x.host WHERE denied <= allowed)"""


@query(f"WITH {_ROBOTS} SELECT url, host, delay_ms FROM a")
def robots_decision(spark: SparkSession, root: str) -> DataFrame:
    """Every crawled URL that its host's rules let in, with the delay."""
    known = table(spark, root, "crawl").select("url", "host").where("url IS NOT NULL").distinct()
    return crawl.allowed(known, table(spark, root, "hosts")).select("url", "host", "delay_ms")


@query("SELECT c_custkey, 'Notes of ' || c_name AS description, 1::BIGINT + len(list_filter(string_split_regex(lower(c_name), '\\W+'), lambda w: regexp_full_match(w, '[a-z]{3,}'))) AS desc_words FROM customer WHERE c_name IS NOT NULL")
def meta_description(spark: SparkSession, root: str) -> DataFrame:
    """Meta descriptions, read from pages made of customers' names, and their indexed words."""
    page = F.concat(F.lit("<html><head><META content='Notes of "), "c_name", F.lit("' name=description><title>t</title></head><body>x</body>"))
    pages = table(spark, root, "customer").where("c_name IS NOT NULL").select(F.col("c_custkey").alias("url"), page.alias("page"))
    return corpus.document_stats(pages).select(F.col("url").alias("c_custkey"), "description", "desc_words")


@query("SELECT p_partkey, p_name AS body FROM part")
def gzip_body(spark: SparkSession, root: str) -> DataFrame:
    """Bodies of responses, every second one of them packed, as text."""

    @F.pandas_udf("binary")
    def packed(key: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else gzip.compress(t.encode()) if k % 2 else t.encode() for k, t in zip(key, text, strict=True)])

    return table(spark, root, "part").select("p_partkey", urls.body_of(packed("p_partkey", "p_name")).alias("body"))


@query("SELECT count(*) AS n, true AS lettered FROM nation")
def random_keys(spark: SparkSession, root: str) -> DataFrame:
    """Random keys: as many different ones as rows, all of which begin with a letter."""
    keys = stage(table(spark, root, "nation").select(urls.random_id().alias("k")), "keys")
    return keys.agg(F.countDistinct("k").alias("n"), F.min(F.col("k").rlike("^[a-z]")).alias("lettered"))


@query(f"SELECT url, {sql.title()} AS title, CAST(len({sql.tokens(sql.body_text())}) AS BIGINT) AS body_words FROM ({sql.PAGES})")
def doc_word_stats(spark: SparkSession, root: str) -> DataFrame:
    return corpus.document_stats(_pages(spark, root)).select("url", "title", "body_words")


@query("WITH p AS (SELECT url, sha256(page) AS digest FROM (" + sql.PAGES + ")) SELECT url, min(url) OVER (PARTITION BY digest) AS canonical_url FROM p")
def content_canonical(spark: SparkSession, root: str) -> DataFrame:
    return corpus.canonical_urls(_pages(spark, root))


# -- index


_TF = f"""WITH p AS ({sql.PAGES}), f AS (SELECT url, 1 AS field, concat_ws(' ', url, {sql.title()}) AS text FROM p UNION ALL SELECT url, 3, {sql.body_text()} FROM p),
    w AS (SELECT url, field, unnest({sql.tokens('text')}) AS word FROM f), tf AS (SELECT url, field, word, count(*) AS cnt FROM w GROUP BY ALL)"""
_POSTINGS = _TF + """, top AS (SELECT url, field, word, cnt, row_number() OVER (PARTITION BY url ORDER BY cnt DESC, word) AS place FROM tf WHERE field = 3 AND cnt > 1),
    postings AS (SELECT word, field, url, cnt FROM tf WHERE field <> 3 UNION ALL SELECT word, field, url, cnt FROM top WHERE place <= 50)"""


_PARTS = "(SELECT *, (row_number() OVER (PARTITION BY word, field ORDER BY url) - 1) // 10000 AS part FROM postings)"


@query(_TF + " SELECT url, field, word, cnt FROM tf")
def term_freq(spark: SparkSession, root: str) -> DataFrame:
    return index.term_frequencies(_pages(spark, root), stemmed=False).select("url", "field", "word", "cnt")


@query(_POSTINGS + " SELECT url, word, cnt FROM postings WHERE field = 3")
def term_freq_top50(spark: SparkSession, root: str) -> DataFrame:
    return index.postings(_pages(spark, root), stemmed=False).where("field = 3").select("url", "word", "cnt")


@query(_POSTINGS + " SELECT word, field, CAST(part AS INT) AS part, count(*) AS n, string_agg(url || '@!#' || cnt, '@@!!##' ORDER BY url) AS list FROM " + _PARTS + " GROUP BY word, field, part")
def inverted_index(spark: SparkSession, root: str) -> DataFrame:
    return index.packed_index(index.postings(_pages(spark, root), stemmed=False))


@query(_POSTINGS + ", enough AS (SELECT word FROM postings GROUP BY word HAVING count(*) >= 2) SELECT word, field, CAST(part AS INT) AS part, count(*) AS n, string_agg(url || '@!#' || cnt, '@@!!##' ORDER BY url) AS list FROM " + _PARTS + " WHERE word IN (FROM enough) GROUP BY word, field, part")
def inverted_index_pruned(spark: SparkSession, root: str) -> DataFrame:
    """Without words that have a single posting."""
    return index.packed_index(index.postings(_pages(spark, root), stemmed=False), min_postings=2)


# Examples of the 1980 paper, and the two later rules.
_STEMS = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss "
    "fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile "
    "analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic "
    "formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit "
    "replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas "
    "controll control roll roll archaeology archaeolog possibly possibl"
).split()
_STEM_ROWS = ", ".join(f"('{w}', '{x}')" for w, x in zip(_STEMS[::2], _STEMS[1::2], strict=True))


@query(f"SELECT * FROM (VALUES {_STEM_ROWS}) t(word, stem)")
def porter_stems(spark: SparkSession, root: str) -> DataFrame:
    """Stems of the published examples."""
    return spark.createDataFrame([(w,) for w in _STEMS[::2]], "word string").select("word", stem_udf("word").alias("stem"))


@query()
def inverted_index_stemmed(spark: SparkSession, root: str) -> DataFrame:
    return index.packed_index(index.postings(_pages(spark, root)))


@query(f"SELECT word, CAST(count(*) AS BIGINT) AS postings, CAST(count(DISTINCT url) AS BIGINT) AS pages FROM ({sql.stored_postings()}) GROUP BY word")
def document_frequency(spark: SparkSession, root: str) -> DataFrame:
    rows = index.stored_postings(table(spark, root, "inv_index"))
    pages = rows.groupBy("word", "url").agg(F.count(F.lit(1)).alias("n"))
    return pages.groupBy("word").agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("pages"))


_PLACES = f"""WITH p AS ({sql.PAGES}), w AS (SELECT url, list_filter(string_split_regex(lower({sql.body_text()}), '\\W+'), lambda x: x <> '') AS ws FROM p),
    e AS (SELECT url, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w)"""


@query(_PLACES + """ SELECT word, CAST(part AS INT) AS part, string_agg(e, ',' ORDER BY n DESC, url) AS list FROM (SELECT *, (row_number() OVER (PARTITION BY word ORDER BY n DESC, url) - 1) // 10000 AS part
    FROM (SELECT word, url, count(*) AS n, url || ':' || string_agg(CAST(place AS VARCHAR), ' ' ORDER BY place) AS e FROM e GROUP BY word, url)) GROUP BY word, part""")
def positional_index(spark: SparkSession, root: str) -> DataFrame:
    return index.positional_lists(index.positions(_pages(spark, root), stemmed=False))


@query()
def positional_index_stemmed(spark: SparkSession, root: str) -> DataFrame:
    return index.positional_lists(index.positions(_pages(spark, root)))


# -- ranks and search


def _stored_graph(spark: SparkSession, root: str) -> DataFrame:
    """``url``, ``links`` of the stored link table, one row a page."""
    from skeinwork.operators.unpack import unpack_values

    rows = table(spark, root, "graph").where("url IS NOT NULL").groupBy("url").agg(F.max("link").alias("link"))
    links = unpack_values(rows, "link", ["url"]).groupBy("url").agg(F.array_sort(F.collect_list("item")).alias("links"))
    return rows.select("url").join(links, "url", "left").select("url", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


_EDGES = f"""g AS (SELECT url, max(link) AS link FROM graph WHERE url IS NOT NULL GROUP BY url), e AS (SELECT url, unnest({sql.values('link')}) AS dst, len({sql.values('link')}) AS n FROM g WHERE link IS NOT NULL)"""


def _rank_sql(rounds: int) -> str:
    parts = ["r0 AS (SELECT url, 1.0::DOUBLE AS rank FROM g)"]
    for i in range(rounds):
        parts.append(f"""r{i + 1} AS (SELECT g.url, 0.85 * coalesce(s.got, 0.0) + (1 - 0.85) AS rank FROM g LEFT JOIN (SELECT e.dst AS url, sum(r.rank / e.n) AS got
            FROM e JOIN r{i} r ON r.url = e.url GROUP BY e.dst) s ON s.url = g.url)""")
    return f"WITH {_EDGES}, " + ", ".join(parts) + f" SELECT url, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(10))
def page_rank(spark: SparkSession, root: str) -> DataFrame:
    return pagerank.pagerank(_stored_graph(spark, root)).select("url", F.round("rank", 6).alias("rank"))


LINE = "search guide stock"
_STATS = """stats AS (SELECT url, max(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) AS title, max(description) AS description, max(TRY_CAST(priority2 AS BIGINT)) AS desc_words, max(TRY_CAST(priority3 AS BIGINT)) AS body_words
    FROM doc_word_count WHERE url IS NOT NULL GROUP BY url)"""


def _stats(spark: SparkSession, root: str) -> DataFrame:
    """One row for each page of the stored statistics, whose rows may be repeated."""
    rows = table(spark, root, "doc_word_count").where("url IS NOT NULL")
    number = lambda c: F.max(F.col(c).try_cast("bigint"))
    return rows.groupBy("url").agg(F.max(F.regexp_replace("title", r"^\s+|\s+$", "")).alias("title"), F.max("description").alias("description"), number("priority2").alias("desc_words"), number("priority3").alias("body_words"))


_HITS = f"""h AS (SELECT * FROM ({sql.stored_postings()}) WHERE word IN ('search', 'guide', 'stock')), n AS (SELECT word, count(*) AS n FROM h GROUP BY word),
    f AS (SELECT word, field, row_number() OVER (PARTITION BY word ORDER BY field) - 1 AS k FROM (SELECT DISTINCT word, field FROM h)),
    heavy AS (SELECT url, sum(cnt * floor(64 / pow(4, k))) AS weight FROM h JOIN f USING (word, field) GROUP BY url ORDER BY weight DESC, url LIMIT 5000),
    w AS (SELECT h.url, h.word, any_value(s.title) AS title, any_value(s.description) AS description, 16 + sum(cnt / sqrt(1 + CASE field WHEN 2 THEN coalesce(desc_words, 0) WHEN 3 THEN coalesce(body_words, 0) ELSE 0 END)) AS w
      FROM h JOIN heavy ON heavy.url = h.url JOIN stats s ON s.url = h.url GROUP BY h.url, h.word),
    scores AS (SELECT url, any_value(title) AS title, any_value(description) AS description, exp(sum(8 / (1 + ln(n)) * ln(w))) AS score FROM w JOIN n USING (word) GROUP BY url)"""


@query(f"WITH {_STATS}, {_HITS} SELECT url, title, description, round(score, 4) AS score FROM scores ORDER BY scores.score DESC, url LIMIT 10")
def search_ranked(spark: SparkSession, root: str) -> DataFrame:
    words = search.query_terms(LINE, stemmed=False)
    out = search.ranked(index.stored_postings(table(spark, root, "inv_index"), words), _stats(spark, root), words)
    return out.select("url", "title", "description", F.round("score", 4).alias("score"))


_ALL_HITS = _HITS.replace(" ORDER BY weight DESC, url LIMIT 5000", "")


@query(f"WITH {_STATS}, {_ALL_HITS} SELECT url, round(score, 4) AS score FROM scores")
def search_scores(spark: SparkSession, root: str) -> DataFrame:
    words = search.query_terms(LINE, stemmed=False)
    out = search.ranked(index.stored_postings(table(spark, root, "inv_index"), words), _stats(spark, root), words, limit=None, candidates=None)
    return out.select("url", F.round("score", 4).alias("score"))


@query(f"WITH {_STATS}, {_HITS} SELECT url, round(score, 4) AS score FROM scores WHERE score < 60 ORDER BY scores.score DESC, url LIMIT 10")
def search_ranked_page2(spark: SparkSession, root: str) -> DataFrame:
    words = search.query_terms(LINE, stemmed=False)
    out = search.ranked(index.stored_postings(table(spark, root, "inv_index"), words), _stats(spark, root), words, bound=60.0)
    return out.select("url", F.round("score", 4).alias("score"))


@query(
    f"""WITH {_STATS}, p AS (SELECT word, url, sum(cnt) AS cnt FROM ({sql.stored_postings()}) WHERE word IN ('search', 'guide', 'stock') GROUP BY word, url), d AS (SELECT word, count(*) AS df FROM p GROUP BY word),
    r AS (SELECT url, max_by(TRY_CAST(regexp_replace(current_score, '^\\s+|\\s+$', '', 'g') AS DOUBLE), struct_pack(a := computed_at, b := TRY_CAST(regexp_replace(current_score, '^\\s+|\\s+$', '', 'g') AS DOUBLE))) AS rank FROM pageranks
      WHERE url IS NOT NULL AND regexp_full_match(regexp_replace(current_score, '^\\s+|\\s+$', '', 'g'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') GROUP BY url)
    SELECT p.url, coalesce(any_value(s.title), p.url) AS title, round(sum((0.8 * p.cnt / (coalesce(desc_words, 0) + coalesce(body_words, 0)) * ln((SELECT count(*) FROM stats) / d.df) + 0.2 * coalesce(r.rank, 0.15)) / 3), 4) AS score
    FROM p JOIN d USING (word) JOIN stats s ON s.url = p.url LEFT JOIN r ON r.url = p.url WHERE coalesce(desc_words, 0) + coalesce(body_words, 0) > 0 GROUP BY p.url"""
)
def search_tfidf(spark: SparkSession, root: str) -> DataFrame:
    text = F.regexp_replace("current_score", r"^\s+|\s+$", "")
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    ranks = table(spark, root, "pageranks").select("url", "computed_at", value.alias("rank")).where("url IS NOT NULL AND rank IS NOT NULL").groupBy("url").agg(F.max_by("rank", F.struct("computed_at", "rank")).alias("rank"))
    out = search.blended(index.stored_postings(table(spark, root, "inv_index"), LINE.split(" ")), _stats(spark, root), ranks, LINE)
    return out.select("url", "title", F.round("score", 4).alias("score"))


_TWICE = _HITS.replace("'search', 'guide', 'stock'", "'search', 'guide'").replace("count(*) AS n FROM h", "count(*) * (CASE word WHEN 'search' THEN 2 ELSE 1 END) AS n FROM h")
_TWICE = _TWICE.replace("sum(cnt * floor(64 / pow(4, k)))", "sum(cnt * floor(64 / pow(4, k)) * (CASE word WHEN 'search' THEN 2 ELSE 1 END))").replace("exp(sum(8 / (1 + ln(n)) * ln(w)))", "exp(sum((CASE word WHEN 'search' THEN 2 ELSE 1 END) * 8 / (1 + ln(n)) * ln(w)))")


@query(f"WITH {_STATS}, {_TWICE} SELECT url, round(score, 4) AS score FROM scores")
def search_repeated(spark: SparkSession, root: str) -> DataFrame:
    """A query that repeats a term: all pages with any of them."""
    words = search.query_terms("search guide search", stemmed=False)
    out = search.ranked(index.stored_postings(table(spark, root, "inv_index"), words), _stats(spark, root), words, limit=None)
    return out.select("url", F.round("score", 4).alias("score"))


@query(f"WITH {_STATS}, {_HITS} SELECT url, title, description, round(score, 4) AS score FROM scores ORDER BY scores.score DESC, url LIMIT 10")
def search_json_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the JSON form of a page of results."""
    rows = F.from_json("json", "array<struct<url:string,title:string,description:string,score:double>>")
    return search_json(spark, root).select(F.inline(rows)).withColumn("score", F.round("score", 4))


@query(f"WITH {_STATS}, {_HITS} SELECT url, round(score, 4) AS score FROM scores ORDER BY scores.score DESC, url LIMIT 10")
def search_saved(spark: SparkSession, root: str) -> DataFrame:
    """A search over postings that were saved in the order of words, of which only the terms' row groups are read."""
    path = f"{staging_root(spark)}/saved-{uuid.uuid4().hex}"
    index.save_postings(index.stored_postings(table(spark, root, "inv_index")), path)
    drop_later(spark, path)
    words = search.query_terms(LINE, stemmed=False)
    out = search.ranked(spark.read.parquet(path), _stats(spark, root), words)
    return out.select("url", F.round("score", 4).alias("score"))


@query()
def search_json(spark: SparkSession, root: str) -> DataFrame:
    words = search.query_terms(LINE, stemmed=False)
    return search.to_json(search.ranked(index.stored_postings(table(spark, root, "inv_index"), words), _stats(spark, root), words))


@query()
def search_built(spark: SparkSession, root: str) -> DataFrame:
    """Index and statistics made from the pages, and a stemmed search over them."""
    pages = _pages(spark, root)
    return search.ranked(index.postings(pages), corpus.document_stats(pages), search.query_terms("steady gardens and moving stones"))


@query("SELECT max_by(page, page) AS page FROM page_cache WHERE url_hash = (SELECT min(url_hash) FROM page_cache WHERE page IS NOT NULL)")
def get_cache(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "page_cache")
    url = pages.where("page IS NOT NULL").agg(F.min_by("url", "url_hash")).first()[0]
    return search.cached_page(pages, url).agg(F.max("page").alias("page"))


# -- crawl


@query(
    f"""WITH RECURSIVE {_EDGES}, k AS (SELECT DISTINCT url AS src, dst FROM e WHERE length(dst) <= 300), s AS (SELECT min(url) AS url FROM g WHERE link LIKE '%view?id=%'),
    t(url, depth) AS (SELECT url, 0 FROM s UNION SELECT k.dst, t.depth + 1 FROM t JOIN k ON k.src = t.url WHERE t.depth < 4)
    SELECT url, CAST(min(depth) AS INT) AS depth FROM t GROUP BY url"""
)
def crawl_frontier(spark: SparkSession, root: str) -> DataFrame:
    """A bounded form that the recursive SQL can check: one seed, four rounds. ``crawl_frontier_whole`` is the whole job."""
    seeds = table(spark, root, "graph").where("link LIKE '%view?id=%'").agg(F.min("url").alias("url"))
    return crawl.frontier(seeds, corpus.edges(_stored_graph(spark, root)), max_depth=4)


@query()
def crawl_frontier_whole(spark: SparkSession, root: str) -> DataFrame:
    """Every page within reach of the least URL of each host, to the full depth of a crawl."""
    seeds = table(spark, root, "graph").where("url IS NOT NULL").groupBy(F.regexp_extract("url", urls.PARTS, 3)).agg(F.min("url").alias("url"))
    return crawl.frontier(seeds, corpus.edges(_stored_graph(spark, root)))


@query()
def crawl_replay(spark: SparkSession, root: str) -> DataFrame:
    """The crawl from the least URL of each host on."""
    pages = table(spark, root, "crawl")
    seeds = pages.where("url IS NOT NULL").groupBy("host").agg(F.min("url").alias("url"))
    return crawl.replay(seeds, pages, table(spark, root, "hosts"))


@query(f"WITH {_ROBOTS} SELECT url, host, CAST(coalesce(sum(delay_ms) OVER (PARTITION BY host ORDER BY url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM a WHERE host IS NOT NULL")
def crawl_schedule(spark: SparkSession, root: str) -> DataFrame:
    """When every allowed page of a host can be fetched, keeping the host's delay."""
    known = table(spark, root, "crawl").select("url", "host").where("url IS NOT NULL").distinct()
    return crawl.polite_schedule(crawl.allowed(known, table(spark, root, "hosts")).withColumn("depth", F.lit(0))).select("url", "host", "start_ms")


@query(
    """SELECT host, CAST(epoch(crawled_at) AS BIGINT) // 600 * 600 AS begin, count(*) AS fetches FROM crawl WHERE crawled_at IS NOT NULL GROUP BY 1, 2"""
)
def fetches_by_host(spark: SparkSession, root: str) -> DataFrame:
    """The batch form of the streaming window count."""
    rows = table(spark, root, "crawl").where("crawled_at IS NOT NULL")
    return rows.groupBy("host", F.window("crawled_at", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("fetches")).select("host", F.unix_timestamp("w.start").alias("begin"), "fetches")


@query("SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_event(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, root, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "ts")
